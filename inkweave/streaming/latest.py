"""The last row of every key as a table that a stream keeps up to date.

Each micro-batch adds one delta with the last row of its keys; nothing older is rewritten, so a
batch costs its own rows. Deltas are folded into a new base every few batches. Folders carry the
batch number: a batch that runs again replaces its own delta, and a base counts only with its
marker, so a failure at any point leaves the table as it was. A late row loses against a newer
one by its time, whichever batch it came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkweave.operators.ordered import last_occurrence

FOLD_EVERY = 8


class LatestTable:
    """Rows of ``schema`` under ``path``, the last of each ``key`` by ``order``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], order: list[str], fold_every: int = FOLD_EVERY):
        self.spark, self.path, self.schema, self.key, self.order, self.fold_every = spark, path.rstrip("/"), schema, key, order, fold_every

    def _done(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, "*/_SUCCESS")) if fs.exists(base) else []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def _parts(self) -> list[str]:
        """The newest base and the deltas after it."""
        bases = self._done("base")
        after = bases[-1] if bases else -1
        return [f"{self.path}/base/{n}" for n in bases[-1:]] + [f"{self.path}/delta/{n}" for n in self._done("delta") if n > after]

    def read(self) -> DataFrame:
        """One row per key. Copies fold before the shuffle."""
        parts = self._parts()
        rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        return last_occurrence(rows, self.key, self.order)

    def add(self, batch: DataFrame, number: int) -> None:
        """The rows of a micro-batch; adding a number again replaces what it added before."""
        bases = self._done("base")
        if bases and number <= bases[-1]:
            return  # folded already, before the stream could note it
        last_occurrence(batch.select(*self.schema.names), self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/delta/{number}")
        if len(self._parts()) > self.fold_every:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base/{number}")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what the stream's source holds now, batch by batch."""
        return (stream.writeStream.foreachBatch(lambda rows, number: self.add(rows, number))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
