"""Job progress logs: what changed, where a job stands, what may be served or removed.

The log is (job_id, ts, event_id, state, meta).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions.fetching import TERMINAL_STATES, is_expired, state_message
from inkweave.operators.ordered import previous, running, time_slot
from inkweave.session import stage


def changes(log: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Rows a watcher sees: state or meta differs from the row before, up to the first end state."""
    slot, order = time_slot(F.col("ts"), slot_seconds), ["ts", "event_id"]
    ends = F.col("state").isin(TERMINAL_STATES).cast("long")
    open_rows = stage(running(log, ["job_id"], slot, [F.col(c) for c in order], sums={"_ended": ends}).where(
        F.col("_ended") - ends == 0).drop("_ended"))
    near = previous(open_rows, ["job_id"], slot, order, ["state", "meta"])
    return near.where(~(F.col("prev_state").eqNullSafe(F.col("state")) & F.col("prev_meta").eqNullSafe(F.col("meta")))).drop(
        "prev_state", "prev_meta")


def payload(state: Column | str, meta: Column | str) -> Column:
    """JSON sent to a watcher; fields without a value are kept."""
    return F.to_json(F.struct(F.col(state).alias("state"), F.col(meta).alias("meta")), {"ignoreNullFields": "false"})


def snapshot(log: DataFrame) -> DataFrame:
    """Latest row per job with its message."""
    latest = F.max_by(F.struct("state", "meta", "ts"), F.struct("ts", "event_id"))
    last = log.groupBy("job_id").agg(latest.alias("_row"), F.count("*").alias("n_updates")).select(
        "job_id", "_row.*", "n_updates")
    return last.withColumn("message", state_message("state")).withColumn(
        "finished", F.col("state").isin(TERMINAL_STATES))


def expired(artifacts: DataFrame, now: Column) -> DataFrame:
    return artifacts.where(is_expired("modified", "expiration", now))


def expired_count(artifacts: DataFrame, now: Column) -> DataFrame:
    return artifacts.agg(F.count_if(is_expired("modified", "expiration", now)).alias("deleted_count"))
