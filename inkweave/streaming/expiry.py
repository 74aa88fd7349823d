"""Retention by due time: artifacts wait in slots of their expiry hour, and a tick reads only what fell due since the last one.

The folder of a slot is a timer: nothing reads it before its hour comes. A batch or a tick that
runs again writes the same folder again, so neither is lost or doubled. An artifact that is due
already when it is listed waits for the next tick. Keys are written once; an artifact that is made
anew has a new key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.functions.fetching import expires_at

SLOT_SECONDS = 3600


class ExpiryWheel:
    """Waiting artifacts under ``path/due/batch=…/slot=…``, ticks and what they removed under ``path/removed/tick=…``."""

    def __init__(self, spark: SparkSession, path: str, slot_seconds: int = SLOT_SECONDS):
        self.spark, self.path, self.micros = spark, path.rstrip("/"), slot_seconds * 1_000_000

    def _last(self, before: int) -> int:
        """Time of the last tick with a smaller number, in microseconds."""
        kind = T.StructType([T.StructField("now_us", T.LongType())])
        self.spark.createDataFrame([], kind).write.mode("append").parquet(f"{self.path}/ticks/tick=-1")
        ticks = self.spark.read.schema("now_us long, tick int").parquet(f"{self.path}/ticks")
        return ticks.where(F.col("tick") < before).agg(F.max("now_us")).first()[0] or 0

    def add(self, artifacts: DataFrame, batch: int) -> None:
        """``artifacts(key, modified, expiration)``: due an hour after they were made, or at their own time if that is earlier."""
        due = F.unix_micros(F.least(expires_at(F.col("modified").cast("timestamp")), F.col("expiration").cast("timestamp")))
        rows = artifacts.select("key", F.greatest(due, F.lit(self._last(2**31 - 1) + 1)).alias("due_us"))
        rows.withColumn("slot", F.floor(F.col("due_us") / self.micros)).write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/due/batch={batch}")

    def due(self, after_us: int, now_us: int) -> DataFrame:
        """(key, due_us) of what fell due in between; other slots are not opened."""
        waiting = self.spark.read.schema("key string, due_us long, batch int, slot long").parquet(f"{self.path}/due")
        return waiting.where(F.col("slot").between(after_us // self.micros, now_us // self.micros) & (F.col("due_us") > after_us) & (F.col("due_us") <= now_us)).select("key", "due_us")

    def tick(self, now_us: int, number: int) -> DataFrame:
        """Remove what fell due since the last tick; the keys removed. Running a tick again gives the same."""
        folder = f"{self.path}/removed/tick={number}"
        self.due(self._last(number), now_us).write.mode("overwrite").parquet(folder)
        self.spark.createDataFrame([(now_us,)], "now_us long").write.mode("overwrite").parquet(f"{self.path}/ticks/tick={number}")
        return self.spark.read.schema("key string, due_us long").parquet(folder)

    def removed(self) -> DataFrame:
        """(key, due_us, tick) of all ticks."""
        return self.spark.read.schema("key string, due_us long, tick int").parquet(f"{self.path}/removed")
