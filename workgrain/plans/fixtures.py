"""Postings, alerts and ledger rows derived from the given tables.

Each view is a set of SQL expressions that both engines read the same way, so
a query and its twin start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A = "(8 + o_orderkey % 40)"
B = "(13 + o_orderkey % 40 + o_orderkey % 17)"

JOBS_RAW = {
    "id": "concat('job-', CAST(o_orderkey AS STRING))",
    "title": """CASE o_orderkey % 10 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Data Analyst (Power BI)'
        WHEN 2 THEN '  kỹ sư dữ liệu ' WHEN 3 THEN 'Machine Learning Engineer' WHEN 4 THEN 'Business Analyst'
        WHEN 5 THEN 'NLP Engineer' WHEN 6 THEN 'Thực tập sinh Data Scientist'
        WHEN 7 THEN 'Analytics Engineer part-time' WHEN 8 THEN 'Kế toán trưởng' ELSE NULL END""",
    "company": """CASE WHEN o_custkey % 50 = 0 THEN '  ' WHEN o_custkey % 51 = 0 THEN NULL
        WHEN o_custkey % 4 = 0 THEN concat(c_name, ' (Đà Nẵng)') ELSE c_name END""",
    "location": """CASE o_custkey % 8 WHEN 0 THEN 'Hà Nội' WHEN 1 THEN 'Ho Chi Minh' WHEN 2 THEN 'Đà Nẵng - Hà Nội'
        WHEN 3 THEN 'Hà Nội & Hồ Chí Minh (mới)' WHEN 4 THEN 'Hải Phòng & 2 nơi khác' WHEN 5 THEN 'Cần Thơ'
        WHEN 6 THEN 'Toàn quốc' ELSE NULL END""",
    "salary": f"""CASE o_orderkey % 11 WHEN 0 THEN 'Thoả thuận' WHEN 1 THEN 'Thỏa thuận'
        WHEN 2 THEN concat(CAST({A} AS STRING), ' - ', CAST({B} AS STRING), ' triệu')
        WHEN 3 THEN concat('Từ ', CAST({A} AS STRING), ' triệu') WHEN 4 THEN concat('Tới ', CAST({B} AS STRING), ' triệu')
        WHEN 5 THEN concat(CAST({A} * 50 AS STRING), ' - ', CAST({B} * 50 AS STRING), ' USD')
        WHEN 6 THEN concat('Up to ', CAST({B} * 50 AS STRING), ' USD') WHEN 7 THEN '1.000 - 2.000 USD'
        WHEN 8 THEN '20,000,000 - 30,000,000 VNĐ' WHEN 9 THEN '' ELSE NULL END""",
    "experience": """CASE o_custkey % 9 WHEN 0 THEN 'Không yêu cầu' WHEN 1 THEN 'Dưới 1 năm' WHEN 2 THEN '1 năm'
        WHEN 3 THEN '3 năm' WHEN 4 THEN 'Trên 5 năm' WHEN 5 THEN '2 - 4 năm' WHEN 6 THEN '3+ years'
        WHEN 7 THEN 'at least 5 years' ELSE NULL END""",
    "description": """CASE o_orderkey % 4 WHEN 0 THEN 'build pipelines with python, kafka and c++'
        WHEN 1 THEN 'react, node and <b>docker</b> on aws' WHEN 2 THEN 'sql server reports' ELSE NULL END""",
    "requirements": """CASE o_orderkey % 5 WHEN 0 THEN 'đại học, python' WHEN 1 THEN 'bachelor or master, java 3 - 5 years'
        WHEN 2 THEN 'cao đẳng' WHEN 3 THEN 'phd' ELSE '' END""",
    "tags": "'data, remote'",
    "source": "CASE o_orderkey % 3 WHEN 0 THEN 'topcv' WHEN 1 THEN 'itviec' ELSE 'linkedin' END",
    "url": """CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat('https://jobs.example/viec-lam/',
        CAST(o_orderkey AS STRING), '.html?ta_source=', o_orderstatus) END""",
    "work_model": """CASE o_orderkey % 6 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'từ xa' WHEN 2 THEN 'At Office'
        WHEN 3 THEN 'Remote' WHEN 4 THEN 'lai' ELSE 'on-site' END""",
    "work_arrangement": """CASE o_orderkey % 4 WHEN 0 THEN 'Toàn thời gian' WHEN 1 THEN 'part-time'
        WHEN 2 THEN 'Thực tập' ELSE 'Full time' END""",
    "posted": "o_orderstatus = 'F'",
    "logo_url": """CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('https://img.example/',
        CAST(o_custkey AS STRING), '.png') END""",
    "crawled_at": "o_orderdate",
    "order_key": "o_orderkey",
}

JOBS_AUDIT = {
    "dag_run_id": "concat('run-', CAST(event_id % 500 AS STRING))",
    "dag_id": "'master_job_elt'",
    "execution_date": "ts",
    "task_id": """concat(event_type, CASE user_id % 4 WHEN 0 THEN '_bronze' WHEN 1 THEN '_silver'
        WHEN 2 THEN '_itviec' ELSE '_topcv' END)""",
    "task_status": "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END",
    "task_duration_seconds": "CAST(floor(value) AS INT)",
    "rows_processed": "user_id",
}

ALERTS = {
    "alert_id": "concat('al-', CAST(c_custkey AS STRING))",
    "user_id": "concat('u-', CAST(c_custkey % 40 AS STRING))",
    "name": "concat('alert ', c_name)",
    "filters": """CASE c_custkey % 7 WHEN 0 THEN '{"keyword":"data"}' WHEN 1 THEN '{"location":"Hà Nội","salary":"all"}'
        WHEN 2 THEN '{"salary":"20to30"}' WHEN 3 THEN '{"salary":"usd_1kto2k","keyword":"ENGINEER"}'
        WHEN 4 THEN '{"category":"data-engineer"}' WHEN 5 THEN '{"location":"other","level":"all"}'
        ELSE '{"keyword":"analyst","salary":"deal"}' END""",
    "timezone": """CASE c_custkey % 4 WHEN 0 THEN 'Asia/Ho_Chi_Minh' WHEN 1 THEN 'Asia/Bangkok'
        WHEN 2 THEN 'UTC' ELSE 'Asia/Tokyo' END""",
    "active": "c_custkey % 11 <> 0",
    "is_blocked": "c_custkey % 13 = 0",
    "email": """CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat('u', CAST(c_custkey % 40 AS STRING),
        '@example.test') END""",
    "last_sent_at": """CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN
        TIMESTAMP_NTZ '2001-08-01 08:00:00' ELSE TIMESTAMP_NTZ '2001-07-20 01:00:00' END""",
    "last_delivered_job_at": """CASE WHEN c_custkey % 3 = 2 THEN TIMESTAMP_NTZ '2001-07-20 00:00:00'
        ELSE NULL END""",
    "created_at": """CASE WHEN c_custkey % 19 = 0 THEN TIMESTAMP_NTZ '2001-08-02 00:30:00' ELSE
        TIMESTAMP_NTZ '2001-07-01 00:00:00' END""",
}

AS_OF = "2001-08-02 01:00:00"


def _items(view: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in view.items()]


def _duck(view: dict[str, str], source: str) -> str:
    items = ",\n  ".join(_items(view)).replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
    return f"SELECT {items}\nFROM {source}"


ORDERS = "orders JOIN customer ON o_custkey = c_custkey"

JOBS_SQL = f"jobs_raw AS ({_duck(JOBS_RAW, ORDERS)})"
AUDIT_SQL = f"jobs_audit AS ({_duck(JOBS_AUDIT, 'events')})"
ALERTS_SQL = f"alerts AS ({_duck(ALERTS, 'customer')})"


# Layouts of the given tables; stating them saves the job that would infer them.
LAYOUTS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when their file gives fewer splits than there are cores.

    Text and page work is bound by the processor, and a small file with one row
    group would keep it on one core. Large inputs have more splits than cores
    and pass through without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def jobs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    customers = table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.selectExpr(*_items(JOBS_RAW))


POSTINGS_A_TASK = 40_000


def page_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks work on the postings' pages is dealt: it is bound by the processor, so their number follows the
    postings, not the bytes that a task reads."""
    cores = spark.sparkContext.defaultParallelism
    return max(cores, -(-table(spark, sf_dir, "orders").count() // POSTINGS_A_TASK))


def jobs_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_items(JOBS_AUDIT))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_items(ALERTS))


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def staging_topcv(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("source") == "topcv").select(
        "id", "title", "company", "logo_url", "url",
        F.col("tags").alias("job_category"),
        F.col("location").alias("working_location"),
        "salary",
        F.col("description").alias("descriptions"),
        "requirements",
        F.col("experience").alias("experiences"),
        F.col("requirements").alias("level_of_education"),
        F.col("work_arrangement").alias("work_model"),
        F.col("posted").alias("posted_to_discord"),
        F.col("crawled_at").alias("created_at"),
    )


def staging_itviec(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("source") == "itviec").select(
        "id", "title", "company", "logo_url", "url",
        F.col("tags").alias("job_category"),
        F.col("location").alias("working_location"),
        "work_model", "tags",
        F.col("description").alias("descriptions"),
        F.concat_ws(" ", "requirements", "experience").alias("requirements_and_experiences"),
        F.col("posted").alias("posted_to_discord"),
        F.col("crawled_at").alias("created_at"),
    )
