"""Pattern joins: text against a small table of regular expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_values(text: str, patterns: Sequence[tuple[str, str]]) -> Column:
    """Array of the values whose pattern is found in a column, in pattern order; patterns without a value give none.

    Written without lambdas, which Spark would evaluate by walking the whole expression for every row.

    The patterns are literals, so each compiles once per task and the match is
    a projection: no join, no shuffle, and rows keep their partition.
    """
    none = F.array().cast("array<string>")
    hits = [F.when(F.rlike(F.col(f"`{text}`"), F.lit(pattern)), F.array(F.lit(value))).otherwise(none) for pattern, value in patterns if value is not None]
    return F.concat(none, *hits)


def explode_patterns(
    rows: DataFrame, text: str, patterns: Sequence[tuple[str, str]], value: str
) -> DataFrame:
    """Left join on a pattern match: one row per hit, one null row without hits."""
    found = rows.withColumn("_values", pattern_values(text, patterns))
    return found.withColumn(value, F.explode_outer("_values")).drop("_values")


GRAM = 3
SLOTS = 1 << 16
#: A pattern that is only text and alternatives; such patterns are found by the runs of characters they require.
_TEXT_ONLY = r"^(\(\?iu?U?\))?[^\\^$.\[\]{}()*+?|]+(\|[^\\^$.\[\]{}()*+?|]+)*$"


def longest_runs(text: Column) -> Column:
    """Every run of GRAM characters of a text, or a shorter text itself."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM)))


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def explode_wanted(rows: DataFrame, texts: Sequence[tuple[str, Column]], wanted: DataFrame, others: Column | None = None) -> DataFrame:
    """A row for each row and each of its distinct keys that may be in ``wanted`` (column ``key``), as column ``key``.

    Keys are the runs of one to GRAM characters of each text (an empty one is its own run), behind the text's prefix,
    and the distinct values of the array ``others``, which are no runs. A table of SLOTS marks, whatever the number of
    wanted keys, keeps rows of other keys from being made; the equality join that follows decides.

    Each place of a text is a row until its key is tested, for the sizes that wanted keys have. That stays in generated
    code, as lambdas over arrays of runs would not; a run counts where it first occurs.
    """
    prefixes = sorted({len(before) for before, _ in texts})
    bare = [F.substr("key", F.lit(before + 1)) for before in prefixes]
    marked = wanted.select(F.explode(F.array(F.struct(F.col("key").alias("mark"), F.lit(-1).alias("size")), *[
        F.struct(run.alias("mark"), F.when(F.length("key") >= before, F.length(run)).otherwise(-1).alias("size"))
        for before, run in zip(prefixes, bare, strict=True)])).alias("m"))
    marks = marked.groupBy(_slot(F.col("m.mark")).alias("id")).agg(F.collect_set("m.size").alias("sizes"))
    all_marks = wanted.sparkSession.range(SLOTS).join(marks, "id", "left")
    there = F.transform(F.array_sort(F.collect_list(F.struct("id", F.col("sizes").isNotNull().alias("there")))), lambda m: m["there"])
    sizes = F.filter(F.array_distinct(F.flatten(F.collect_list("sizes"))), lambda n: n.between(0, GRAM))
    dense = all_marks.agg(F.struct(there.alias("there"), sizes.alias("sizes"))).scalar()

    which, at, n = F.col("__which"), F.col("__at"), F.col("__n")
    named = {f"__text{i}": text for i, (_, text) in enumerate(texts)} | ({} if others is None else {"__others": others})
    text, prefix = F.lit(None).cast("string"), F.lit("")
    for i, (before, _) in enumerate(texts):
        text, prefix = F.when(which == i, F.col(f"__text{i}")).otherwise(text), F.when(which == i, F.lit(before)).otherwise(prefix)
    is_text, size = which < len(texts), F.col("__size")
    length, tried = F.length("__text"), dense["sizes"]
    if others is not None:
        length, tried = F.when(is_text, length).otherwise(F.size("__others")), F.when(is_text, tried).otherwise(F.array(F.lit(1)))
    ends = F.greatest(size, F.when(is_text, F.lit(1)))
    parts = rows.withColumns(named).withColumn("__which", F.explode(F.sequence(F.lit(0), F.lit(len(named) - 1))))
    places = parts.withColumn("__text", text).withColumn("__size", length).withColumn(
        "__at", F.explode(F.when(ends > 0, F.sequence(F.lit(1), ends))))
    runs = places.withColumn("__n", F.explode(tried))
    run = F.substr(F.col("__text"), at, n)
    inside = (at + n - 1 <= size) & ((n > 0) | (size == 0))
    first = F.instr(F.col("__text"), run) == at
    for i, (before, _) in enumerate(texts):
        for j in (j for j in range(i) if texts[j][0] == before):
            before_it = (F.instr(F.col(f"__text{j}"), run) > 0) & ((n > 0) | (F.length(f"__text{j}") == 0))
            first = first & ((which != i) | ~F.coalesce(before_it, F.lit(False)))
    key, mark = F.concat(prefix, run), run
    if others is not None:
        other = F.get("__others", at - 1)
        key, mark, first = F.when(is_text, key).otherwise(other), F.when(is_text, run).otherwise(other), ~is_text | first
    found = runs.filter(inside & F.get(dense["there"], _slot(mark)) & first).withColumn("key", key)
    return found.drop(*named, "__which", "__text", "__size", "__at", "__n")


def join_patterns(rows: DataFrame, text: str, table: DataFrame, pattern: str) -> DataFrame:
    """The same left join against a pattern table of any size.

    Each distinct text is matched once and joined back on equality. A pattern that is only text and alternatives
    requires one of its alternatives, so it meets only texts that have the same run of characters, in an equality
    join, and is then matched. Other patterns meet every distinct text; there is no such join where there are none.
    """
    texts = rows.select(text).where(F.col(text).isNotNull()).distinct()
    plain = table.withColumn("_row", F.monotonically_increasing_id()).filter(F.col(pattern).rlike(_TEXT_ONLY))
    bare = F.lower(F.regexp_replace(F.col(pattern), r"^\(\?[iuU]+\)", ""))
    literals = plain.withColumn("_literal", F.explode(F.split(bare, r"\|")))
    # The run whose hash is smallest, so that patterns with a common beginning do not all share a key.
    chosen = F.array_min(F.transform(longest_runs(F.col("_literal")), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]
    keyed = literals.withColumn("key", chosen).drop("_literal")
    offered = explode_wanted(texts, [("", F.lower(text))], keyed.select("key").distinct())
    test = F.expr(f"`{text}` rlike `{pattern}`")
    hits = offered.join(keyed, "key").where(test).dropDuplicates([text, "_row"]).select(text, *table.columns)
    others = table.filter(~F.col(pattern).rlike(_TEXT_ONLY))
    if not others.isEmpty():
        hits = hits.unionByName(texts.join(others, test).select(text, *table.columns))
    return rows.join(hits, text, "left")
