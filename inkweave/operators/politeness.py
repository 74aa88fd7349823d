"""Pacing per host over a fetch log: streaks, penalties and the delay each request left behind.

The log is (host, ts, outcome, event_id); ``outcome`` as in the fetch classes. A host may hold
any share of the log: totals run through time slots, and the clamped walk of the job profile runs
through chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import let
from inkweave.functions.fetching import (
    DELAY_STEP, INITIAL_DELAY, MAX_DELAY, MIN_DELAY, PENALTY_SECONDS, SUCCESSES_PER_STEP)
from inkweave.operators.ordered import position_slot, previous, running, time_slot
from inkweave.session import stage

CHUNK_ROWS = 2_000
#: Steps of a chunk that are put together at once.
BLOCK_ROWS = 50
ORDER = ["ts", "event_id"]


def _ordered() -> list[Column]:
    return [F.col(c) for c in ORDER]


def success_streak(log: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Add ``streak``: pages since the last failure or non-HTML page, restarting after each full five.

    ``run`` is the same without restarts, ``nth`` the request's number on its host. Every running
    total reads its input twice, so results that feed another total are staged first.
    """
    slot, good = time_slot(F.col("ts"), slot_seconds), F.col("outcome") == "ok"
    counted = stage(running(log, ["host"], slot, _ordered(), sums={
        "_good": good.cast("long"), "nth": F.lit(1).cast("long")}))
    reset = F.when(F.col("outcome").isin("failed", "empty", "not_html"), F.col("_good"))
    based = running(counted, ["host"], slot, _ordered(), maxima={"_base": reset})
    run = F.col("_good") - F.coalesce("_base", F.lit(0))
    return based.withColumn("run", run).withColumn("streak", F.pmod(run, F.lit(SUCCESSES_PER_STEP))).drop("_good", "_base")


def penalty_interval(log: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Add ``penalty_until`` and ``in_penalty`` of each request, from the limits before it."""
    limited_at = F.when(F.col("outcome") == "limited", F.unix_micros(F.col("ts").cast("timestamp")))
    last = running(log, ["host"], time_slot(F.col("ts"), slot_seconds), _ordered(), maxima={"_limited": limited_at})
    until = F.timestamp_micros(F.col("_limited") + F.lit(PENALTY_SECONDS * 1_000_000))
    return last.withColumn("penalty_until", until).withColumn(
        "in_penalty", F.coalesce(F.col("ts").cast("timestamp") < until, F.lit(False))).drop("_limited")


def adaptive_delay_v1(log: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Add ``delay`` after each request, command-line profile.

    A limit sets the maximum until the first request outside its penalty; that request and every
    failure restart from the initial delay; each five pages in a row take one step off.
    """
    slot = time_slot(F.col("ts"), slot_seconds)
    marked = stage(penalty_interval(log, slot_seconds))
    out = ~F.col("in_penalty")
    ok_out, failed = (F.col("outcome") == "ok") & out, F.col("outcome").isin("failed", "empty")
    limited = F.col("outcome") == "limited"
    moves = stage(running(marked, ["host"], slot, _ordered(), sums={
        "_n": F.lit(1).cast("long"), "_ok": ok_out.cast("long")}))
    last = running(moves, ["host"], slot, _ordered(), maxima={
        "_limit_n": F.when(limited, F.col("_n")),
        "_out_n": F.when(~limited & out & (ok_out | failed), F.col("_n")),
        "_base": F.when(limited | failed, F.col("_ok")),
    })
    held = F.col("_limit_n") > F.coalesce("_out_n", F.lit(0))
    steps = F.floor((F.col("_ok") - F.coalesce("_base", F.lit(0))) / F.lit(SUCCESSES_PER_STEP))
    walked = F.greatest(F.lit(MIN_DELAY), F.lit(INITIAL_DELAY) - F.lit(DELAY_STEP) * steps)
    return last.withColumn("delay", F.when(F.coalesce(held, F.lit(False)), F.lit(MAX_DELAY)).otherwise(walked)).select(
        *log.columns, "delay")


def _replay(steps: Column, start: Column, move: Callable[[Column, Column], Column]) -> Column:
    """Value after each step. Appending copies what is there, so steps go by blocks: a row is copied with its block and the block with the others."""
    nothing = F.expr("cast(array() as array<double>)")

    def through(value: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(value.alias("x"), nothing.alias("out")), lambda acc, s: let(move(acc["x"], s), lambda x: F.struct(
            x.alias("x"), F.concat(acc["out"], F.array(x)).alias("out"))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / F.lit(BLOCK_ROWS)).cast("int")), lambda i: F.slice(steps, i * BLOCK_ROWS + 1, BLOCK_ROWS))
    return F.flatten(F.aggregate(
        blocks, F.struct(start.alias("x"), F.expr("cast(array() as array<array<double>>)").alias("out")),
        lambda acc, block: let(through(acc["x"], block), lambda done: F.struct(
            done["x"].alias("x"), F.concat(acc["out"], F.array(done["out"])).alias("out"))))["out"])


def adaptive_delay_v2(log: DataFrame, slot_seconds: int = 3600, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``delay`` after each request, job profile: a walk clamped at both ends.

    A step is ``x -> min(high, max(low, x + add))``. Such functions compose to one of the same
    form, so every chunk folds to three numbers, a host's chunks chain in order, and each chunk
    then replays its steps from its own start.
    """
    streaks = success_streak(log, slot_seconds)
    add = (
        F.when((F.col("outcome") == "ok") & (F.col("streak") == 0), -DELAY_STEP)
        .when(F.col("outcome").isin("failed", "empty"), DELAY_STEP)
        .when(F.col("outcome") == "limited", 2 * DELAY_STEP)
        .otherwise(0.0)
    )
    placed = stage(streaks.withColumn("add", add).select(*log.columns, "add", F.col("nth").alias("_n")))
    rest = [c for c in log.columns if c != "host"]
    chunks = placed.groupBy("host", position_slot(F.col("_n") - 1, chunk_rows).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("_n", "add", *rest))).alias("steps"))

    def clamp(value: Column, step: Column) -> Column:
        return F.least(F.lit(MAX_DELAY), F.greatest(F.lit(MIN_DELAY), value + step["add"]))

    whole = F.aggregate(
        "steps",
        F.struct(F.lit(0.0).alias("add"), F.lit(MIN_DELAY).alias("low"), F.lit(MAX_DELAY).alias("high")),
        lambda acc, s: F.struct((acc["add"] + s["add"]).alias("add"), clamp(acc["low"], s).alias("low"),
                                clamp(acc["high"], s).alias("high")))
    hosts = chunks.select("host", "chunk", whole.alias("f")).groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "f"))).alias("chunks"))
    after = _replay(F.col("chunks"), F.lit(INITIAL_DELAY), lambda x, c: F.least(
        c["f"]["high"], F.greatest(c["f"]["low"], x + c["f"]["add"])))
    before = F.slice(F.concat(F.array(F.lit(INITIAL_DELAY)), after), 1, F.size("chunks"))
    starts = hosts.select("host", F.inline(F.arrays_zip(F.col("chunks.chunk").alias("chunk"), before.alias("start"))))
    replayed = chunks.join(starts, ["host", "chunk"]).withColumn("delays", _replay(F.col("steps"), F.col("start"), clamp))
    return replayed.select("host", F.explode(F.arrays_zip("steps", "delays")).alias("z")).select(
        "host", *[F.col(f"z.steps.{c}").alias(c) for c in rest], F.col("z.delays").alias("delay")).select(
        *log.columns, "delay")


def request_pace(delays: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Delay actually waited: the maximum inside a penalty, else the adaptive delay."""
    return penalty_interval(stage(delays), slot_seconds).withColumn(
        "waited", F.when(F.col("in_penalty"), F.lit(MAX_DELAY)).otherwise(F.col("delay")))


def pace_report(log: DataFrame, every_seconds: int = 3600, slot_seconds: int = 3600) -> DataFrame:
    """How each host was asked in each interval: counts by outcome, gaps between requests, requests too soon after a limit.

    (host, interval_us, n_requests, n_ok, n_limited, n_failed, n_in_penalty (the limited one included), min_gap_us, sum_gap_us,
    n_too_fast). A gap belongs to the interval of its later request; one under the least delay is
    too fast. It replays no timer: everything comes from the recorded times.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = stage(penalty_interval(log, slot_seconds))
    gaps = previous(marked, ["host"], time_slot(F.col("ts"), slot_seconds), ORDER, ["ts"]).withColumn(
        "gap", us - F.unix_micros(F.col("prev_ts").cast("timestamp")))
    is_, span = lambda *names: F.count_if(F.col("outcome").isin(*names)), every_seconds * 1_000_000
    return gaps.groupBy("host", (F.floor(us / F.lit(span)) * span).cast("long").alias("interval_us")).agg(
        F.count("*").alias("n_requests"), is_("ok").alias("n_ok"), is_("limited").alias("n_limited"), is_("failed", "empty").alias("n_failed"),
        F.count_if("in_penalty").alias("n_in_penalty"), F.min("gap").alias("min_gap_us"), F.sum("gap").alias("sum_gap_us"),
        F.count_if(F.col("gap") < F.lit(int(MIN_DELAY * 1_000_000))).alias("n_too_fast"))
