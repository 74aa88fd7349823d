import datetime as dt

from pyspark.sql import functions as F

from inkweave.streaming.expiry import ExpiryWheel

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def us(minutes):
    return int((at(minutes) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def keys(df):
    return sorted(r["key"] for r in df.collect())


def test_ticks_remove_once_and_read_what_is_due(spark, tmp_path):
    wheel = ExpiryWheel(spark, str(tmp_path / "w"), slot_seconds=600)
    kind = "key string, modified timestamp, expiration timestamp"
    rows = [(f"k{m}", at(m), None) for m in range(0, 600, 7)] + [("own", at(0), at(20)), ("late", at(0), at(500))]
    first = spark.createDataFrame([r for r in rows if r[1] <= at(90)], kind)
    wheel.add(first, 0)
    wheel.add(first, 0)  # a batch that runs again
    assert keys(wheel.tick(us(70), 0)) == sorted(["k0", "k7", "own", "late"])
    assert keys(wheel.tick(us(70), 0)) == sorted(["k0", "k7", "own", "late"])  # a tick that runs again
    wheel.add(spark.createDataFrame([r for r in rows if r[1] > at(90)] + [("past", at(-300), None)], kind), 1)
    assert keys(wheel.tick(us(80), 1)) == ["k14", "past"]
    want = [f"k{m}" for m in range(0, 600, 7) if 20 < m <= 240]
    assert keys(wheel.tick(us(300), 2)) == sorted(want)
    assert wheel.removed().count() == wheel.removed().select("key").distinct().count() == 4 + 2 + len(want)
    few, all_files = wheel.due(us(300), us(320)), spark.read.parquet(str(tmp_path / "w" / "due"))
    assert 0 < len(few._jdf.inputFiles()) and few.count() == len([m for m in range(0, 600, 7) if 240 < m <= 260])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan.split("PartitionFilters: [")[1].split("]")[0] and all_files.select(F.countDistinct("slot")).first()[0] > 40
