import datetime as dt
import random
import time

from pyspark.sql import functions as F

from inkweave.functions import fetching
from inkweave.operators import ordered, politeness, progress
from inkweave.streaming import live

BASE = dt.datetime(2024, 1, 1)


def simulate_v2(log):
    delay, streak, out = 0.75, 0, []
    for outcome in log:
        if outcome == "ok":
            streak += 1
            if streak >= 5:
                delay, streak = max(0.25, delay - 0.25), 0
        elif outcome == "limited":
            delay = min(5.0, delay + 0.5)
        else:
            streak = 0
            if outcome == "failed":
                delay = min(5.0, delay + 0.25)
        out.append(delay)
    return out


def make_log(spark, outcomes, seconds=3):
    rows = [(h, BASE + dt.timedelta(seconds=seconds * i), i, o) for h, log in outcomes.items() for i, o in enumerate(log)]
    return spark.createDataFrame(rows, "host long, ts timestamp, event_id long, outcome string")


def test_delay_fixture(spark):
    log = make_log(spark, {1: ["ok"] * 5 + ["failed", "limited"]})
    got = [r.delay for r in politeness.adaptive_delay_v2(log).orderBy("event_id").collect()]
    assert got == [0.75] * 4 + [0.5, 0.75, 1.25]


def test_delay_over_slots_and_chunks(spark):
    rng = random.Random(3)
    logs = {h: rng.choices(["ok", "failed", "limited", "not_html"], [w, 2, 1, 1], k=400) for h, w in ((1, 2), (2, 30), (3, 8))}
    got = politeness.adaptive_delay_v2(make_log(spark, logs), slot_seconds=60, chunk_rows=7).orderBy("host", "event_id").collect()
    for h, log in logs.items():
        assert [r.delay for r in got if r.host == h] == simulate_v2(log)


def test_retry_after(check):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    check("h string, want double", [("120", 15.0), ("0", 0.25), ("soon", 8.0), (None, 8.0), ("-5", 0.25),
                                    ("Mon, 01 Jan 2024 00:00:09 GMT", 9.0), ("Mon, 1 Jan 2024 00:00:04 GMT", 4.0)],
          fetching.retry_after("h", now))
    check("h string, want double", [("120", 120.0), ("Sun, 31 Dec 2023 00:00:00 GMT", 0.1), ("x", 8.0)],
          fetching.retry_after("h", now, "v1"))


def test_running_and_previous_match_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, n long, v long")
    slot = ordered.position_slot(F.col("n"), 13)
    got = ordered.running(df, ["g"], slot, [F.col("n")], sums={"s": F.col("v")}, maxima={"m": F.col("v")})
    got = ordered.previous(got, ["g"], slot, ["n"], ["v"])
    want = df.createOrReplaceTempView("t") or spark.sql(
        "select g, n, v, sum(v) over w s, max(v) over w m, lag(v) over w prev_v from t window w as (partition by g order by n)")
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == 500
    placed = ordered.numbered_by_range(df, ["g"], ["n"], "pos", partitions=7)
    counted = spark.sql("select g, n, v, row_number() over (partition by g order by n) pos from t")
    assert placed.select(counted.columns).exceptAll(counted).count() == 0


def test_progress_changes(spark):
    states = ["PENDING", "STARTED", "PROGRESS", "PROGRESS", "SUCCESS", "PROGRESS"]
    rows = [(1, BASE + dt.timedelta(seconds=i), i, s, "m") for i, s in enumerate(states)]
    log = spark.createDataFrame(rows, "job_id long, ts timestamp, event_id long, state string, meta string")
    got = progress.changes(log, slot_seconds=2).orderBy("event_id").collect()
    assert [r.event_id for r in got] == [0, 1, 2, 4]
    assert log.select(progress.payload("state", "meta").alias("p")).first().p \
        == '{"state":"PENDING","meta":"m"}'


def test_retention_limits(spark):
    now = F.lit("2024-01-01 02:00:00").cast("timestamp")
    rows = [("kept", BASE + dt.timedelta(minutes=61), None), ("aged", BASE + dt.timedelta(minutes=60), None),
            ("stamped", BASE + dt.timedelta(minutes=110), BASE + dt.timedelta(minutes=115))]
    artifacts = spark.createDataFrame(rows, "key string, modified timestamp, expiration timestamp")
    assert {r.key for r in progress.expired(artifacts, now).collect()} == {"aged", "stamped"}
    assert progress.expired_count(artifacts, now).first().deleted_count == 2


def test_streams_over_many_batches_match_batch(spark, tmp_path):
    rng = random.Random(11)
    logs = {h: rng.choices(["ok", "failed", "limited", "not_html"], [8, 2, 1, 1], k=90) for h in (1, 2)}
    source = make_log(spark, logs).cache()
    for part in range(3):
        source.where((F.col("event_id") >= part * 30) & (F.col("event_id") < part * 30 + 30)).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = live.drain(live.adaptive_delay(stream))
    want = politeness.adaptive_delay_v2(source)
    assert got.count() == 180 and got.select(want.columns).exceptAll(want).count() == 0
    states = F.when(F.col("event_id") == 70, "SUCCESS").when(F.col("event_id") % 7 < 3, "STARTED").otherwise("PROGRESS")

    def as_jobs(df):
        return df.select(F.col("host").alias("job_id"), "ts", "event_id", states.alias("state"), F.col("outcome").alias("meta"))
    got = live.drain(live.progress_changes(as_jobs(stream)))
    want = progress.changes(as_jobs(source))
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0


def test_periodic_retention(spark, tmp_path):
    rows = [("old", BASE, None), ("new", BASE + dt.timedelta(hours=2), None)]
    listing = spark.createDataFrame(rows, "key string, modified timestamp, expiration timestamp")
    gone, keys = str(tmp_path / "gone"), lambda: sorted(r.key for r in spark.read.parquet(str(tmp_path / "gone")).collect())
    first, later = (F.lit(f"2024-01-01 {t}:30:00").cast("timestamp") for t in ("02", "09"))
    live.sweep(listing, first, gone)
    assert keys() == ["old"]
    live.sweep(listing, first, gone)
    assert keys() == ["old"]
    query = live.retention(spark, lambda: listing, lambda: later, gone, str(tmp_path / "check"), every="1 second")
    try:
        for _ in range(60):
            if keys() == ["new", "old"]:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert keys() == ["new", "old"]


def test_pace_report(spark):
    from inkweave.operators import politeness
    rows = [("h", t, k, o) for k, (t, o) in enumerate([("00:00:00.0", "ok"), ("00:00:00.1", "limited"), ("00:00:05", "ok"), ("01:00:00", "failed"), ("01:00:01", "not_html")])]
    log = spark.createDataFrame(rows, "host string, t string, event_id long, outcome string").selectExpr("host", "timestamp('2024-01-01 ' || t) AS ts", "event_id", "outcome")
    got = [tuple(r)[2:] for r in politeness.pace_report(log, slot_seconds=2).orderBy("interval_us").collect()]
    assert got == [(3, 2, 1, 0, 2, 100_000, 5_000_000, 1), (2, 0, 0, 1, 0, 1_000_000, 3_596_000_000, 0)]


def test_walk_needs_no_python_and_pace_runs_the_walk_once(spark):
    """A group of Python for every host cost more than the walk; a total that reads the walk twice ran it twice."""
    logs = {h: ["ok", "failed", "limited", "ok", "ok"] * 9 for h in range(1, 4)}
    delays = politeness.adaptive_delay_v2(make_log(spark, logs), chunk_rows=4)
    assert "Pandas" not in delays._jdf.queryExecution().executedPlan().toString()
    paced = politeness.request_pace(delays)
    assert "array" not in paced._jdf.queryExecution().executedPlan().toString()
    long = ["limited", "ok", "failed"] * 130  # chunks and steps over several blocks
    got = politeness.adaptive_delay_v2(make_log(spark, {1: long}), chunk_rows=120).orderBy("event_id").collect()
    assert [r.delay for r in got] == simulate_v2(long)
    got = politeness.adaptive_delay_v2(make_log(spark, {1: long}), chunk_rows=2).orderBy("event_id").collect()
    assert [r.delay for r in got] == simulate_v2(long)
