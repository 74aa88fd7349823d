import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.streaming.latest import LatestTable

SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("status", T.IntegerType())])


def test_batches_late_rows_and_repeats(spark, tmp_path):
    r, table = random.Random(1), LatestTable(spark, str(tmp_path / "t"), SCHEMA, ["url"], ["ts"], fold_every=3)
    assert table.read().collect() == []
    rows = [(f"u{r.randrange(20)}", ts, r.randrange(600)) for ts in r.sample(range(200), 90)]  # any order: many come late
    want = {}
    for number in range(9):
        part = rows[number * 10 : number * 10 + 10]
        batch = spark.createDataFrame(part, SCHEMA)
        table.add(batch, number)
        if number % 2:
            table.add(batch, number)  # the same batch again
        for u, ts, s in part:
            want[u] = max(want.get(u, (-1, 0)), (ts, s))
        assert {x.url: (x.ts, x.status) for x in table.read().collect()} == want
    assert len(table._parts()) <= 4 and LatestTable(spark, str(tmp_path / "t"), SCHEMA, ["url"], ["ts"]).read().count() == len(want)


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    log, table = str(tmp_path / "log"), LatestTable(spark, str(tmp_path / "t"), SCHEMA, ["url"], ["ts"], fold_every=2)
    for k in range(6):
        spark.createDataFrame([("a", k, k), (f"n{k}", 1, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(log)
        if k % 2:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(log)
            table.follow(stream, str(tmp_path / "c")).awaitTermination()
    got = {x.url: x.status for x in table.read().collect()}
    assert got == {"a": 5, **{f"n{k}": 0 for k in range(6)}}
    assert table.read().where(F.col("url") == "a").count() == 1
