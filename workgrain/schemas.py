"""Row layouts of the canonical tables."""

from __future__ import annotations

POSTING_TEXT = (
    "id", "title", "company", "location", "salary", "experience", "description",
    "requirements", "tags", "source", "url",
)
POSTING_COLUMNS = (*POSTING_TEXT, "crawled_at", "embedding")

RAW_JOBS = (
    ", ".join(f"{name} string" for name in POSTING_TEXT)
    + ", crawled_at timestamp_ntz, embedding array<float>"
)

# Text fields whose change makes a stored vector stale.
SEMANTIC_FIELDS = ("title", "experience", "description", "requirements")

STAGING_TOPCV = (
    "title string, company string, logo_url string, url string, job_category string, "
    "working_location string, salary string, descriptions string, requirements string, "
    "experiences string, level_of_education string, work_model string, "
    "posted_to_discord boolean, created_at timestamp_ntz"
)
STAGING_ITVIEC = (
    "title string, company string, logo_url string, url string, job_category string, "
    "working_location string, work_model string, tags string, descriptions string, "
    "requirements_and_experiences string, posted_to_discord boolean, created_at timestamp_ntz"
)

# Ledger key, the columns a second write of the same key refreshes, and text caps.
LEDGER_KEY = ("dag_run_id", "task_id", "execution_date")
LEDGER_REFRESHED = (
    "task_status", "task_end_date", "task_duration_seconds", "task_retry_count",
    "rows_processed", "rows_inserted", "rows_updated", "rows_scraped", "rows_posted_discord",
    "dbt_models_run", "dbt_models_success", "dbt_models_failed", "error_message", "error_type",
    "exception_traceback", "discord_posts_sent", "discord_posts_failed", "updated_at",
)
LEDGER_CAPS = {"error_message": 5_000, "exception_traceback": 10_000}
