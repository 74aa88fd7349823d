"""HTTP outcome classes, Retry-After, expiry and download rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweave.functions import as_col, blank_to_null
from inkweave.functions.urls import is_html_v2

# Pacing of the crawler, in seconds unless named otherwise.
INITIAL_DELAY = 0.75
MIN_DELAY = 0.25
MAX_DELAY = 5.0
DELAY_STEP = 0.25
SUCCESSES_PER_STEP = 5
DEFAULT_WAIT = 8.0
PENALTY_SECONDS = 20
RETENTION_HOURS = 1


def is_limited(status: Column | str, profile: str = "v2") -> Column:
    """429 counts in both profiles, 503 in the job profile only."""
    codes = [429, 503] if profile == "v2" else [429]
    return as_col(status).isin(codes)


def fetch_outcome(url: Column | str, status: Column | str, content_type: Column | str,
                  has_body: Column | str) -> Column:
    """limited / failed / empty / not_html / ok, tested in that order."""
    code = as_col(status)
    return (
        F.when(is_limited(code), "limited")
        .when(code.isNull() | ~code.between(200, 299), "failed")
        .when(~as_col(has_body), "empty")
        .when(~is_html_v2(url, content_type), "not_html")
        .otherwise("ok")
    )


def retry_after(header: Column | str, now: Column | str, profile: str = "v2") -> Column:
    """Seconds to wait: whole seconds, or an HTTP date, else the default."""
    text = F.trim(as_col(header))
    seconds = F.when(text.rlike(r"^[+\-]?\d+$"), text.try_cast("double"))
    dated = F.try_to_timestamp(
        F.regexp_replace(F.regexp_extract(text, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1), r"^(\d) ", "0$1 "),
        F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(dated) - F.unix_micros(as_col(now).cast("timestamp"))) / F.lit(1e6)
    if profile == "v2":
        wait = F.coalesce(seconds, until, F.lit(DEFAULT_WAIT))
        return F.greatest(F.lit(MIN_DELAY), F.least(wait, F.lit(MAX_DELAY * 3)))
    dated_wait = F.when(until.isNotNull(), F.greatest(F.lit(0.1), until))
    return F.coalesce(seconds, dated_wait, F.lit(DEFAULT_WAIT))


def expires_at(created: Column | str, hours: int = RETENTION_HOURS) -> Column:
    return as_col(created) + F.expr(f"INTERVAL {hours} HOURS")


def is_expired(modified: Column | str, expiration: Column | str, now: Column,
               hours: int = RETENTION_HOURS) -> Column:
    aged = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(as_col(modified).cast("timestamp"))
            >= F.lit(hours * 3_600_000_000))
    return aged | F.coalesce(now >= as_col(expiration), F.lit(False))


# Served types by artifact extension.
CONTENT_TYPES = {".md": "text/markdown; charset=UTF-8", ".zip": "application/zip"}
DEFAULT_CONTENT_TYPE = "application/octet-stream"


def artifact_content_type(key: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(as_col(key), r"[^/.][^/]*?(\.[^./]*)$", 1))
    served = F.lit(DEFAULT_CONTENT_TYPE)
    for suffix, kind in CONTENT_TYPES.items():
        served = F.when(ext == suffix, kind).otherwise(served)
    return served


def artifact_disposition(key: Column | str) -> Column:
    return F.concat(F.lit('attachment; filename="'), F.regexp_extract(as_col(key), r"([^/]*)$", 1), F.lit('"'))


# States of a job and what a watcher is told.
TERMINAL_STATES = ["SUCCESS", "FAILURE", "REVOKED"]


def state_message(state: Column | str) -> Column:
    s = as_col(state)
    return (
        F.when(s == "PENDING", "Task is waiting to be processed.")
        .when(s == "STARTED", "Task has started.")
        .when(s == "PROGRESS", "Task is in progress.")
        .when(s == "SUCCESS", "Task completed successfully.")
        .when(s == "FAILURE", "Task failed.")
        .when(s == "REVOKED", F.concat(F.lit("Task is in state: "), s))
        .otherwise(F.concat(F.lit("Task is in an unknown state: "), s))
    )


def download_verdict(state: Column | str, bucket: Column | str, key: Column | str) -> Column:
    """ok, or why a finished artifact cannot be served."""
    s = as_col(state)
    located = blank_to_null(as_col(bucket)).isNotNull() & blank_to_null(as_col(key)).isNotNull()
    return (
        F.when(~s.isin(TERMINAL_STATES), "404 not completed")
        .when(s != "SUCCESS", "500 job failed")
        .when(~located, "500 no storage information")
        .otherwise("200 ok")
    )
