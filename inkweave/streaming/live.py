"""Streaming queries: live progress, live pacing, periodic retention."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkweave.operators.progress import expired
from inkweave.session import shared_dir
from inkweave.streaming.processors import CHANGE_SCHEMA, DELAY_SCHEMA, AdaptiveDelay, ProgressChanges

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need this state store; it also keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def progress_changes(log: DataFrame) -> DataFrame:
    """``log(job_id, ts, event_id, state, meta)`` as a stream; gives the rows a watcher sees."""
    use_rocksdb(log.sparkSession)
    return log.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=ProgressChanges(), outputStructType=CHANGE_SCHEMA, outputMode="Update", timeMode="None")


def adaptive_delay(log: DataFrame) -> DataFrame:
    """``log(host, ts, event_id, outcome)`` as a stream; adds the delay after each request."""
    use_rocksdb(log.sparkSession)
    return log.groupBy("host").transformWithStateInPandas(
        statefulProcessor=AdaptiveDelay(), outputStructType=DELAY_SCHEMA, outputMode="Update", timeMode="None")


def sweep(listing: DataFrame, now: Column, removed_path: str) -> None:
    """Append the keys that are expired at ``now`` and were not removed before; run again it adds nothing."""
    spark = listing.sparkSession
    kinds = f"key {listing.schema['key'].dataType.simpleString()}"
    spark.createDataFrame([], kinds).write.mode("append").parquet(removed_path)
    removed = spark.read.schema(kinds).parquet(removed_path)
    expired(listing, now).select("key").distinct().join(removed, "key", "left_anti").write.mode("append").parquet(removed_path)


def retention(spark: SparkSession, listing: Callable[[], DataFrame], now: Callable[[], Column], removed_path: str, checkpoint: str, every: str = "1 hour") -> StreamingQuery:
    """Sweep the whole listing, as it is then, at every tick of a clock.

    An artifact that is fresh at one tick is looked at again at the next. A retried tick adds no key.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (clock.writeStream.foreachBatch(lambda batch, batch_id: sweep(listing(), now(), removed_path))
            .option("checkpointLocation", checkpoint).trigger(processingTime=every).start())


def drain(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Run a stream over what its source holds now and give the rows it wrote.

    Each micro-batch writes its own folder, so a retried batch replaces its rows.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(keep)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows/*")
