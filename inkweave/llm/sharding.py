"""Shards by fixed virtual slots: rows hash into slots for ever, a versioned map says which shard holds a slot.

Only the map changes when data grow or a shard is added: ``rebalance`` frees the slots that a shard
holds beyond its share and gives them to the emptiest shards. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed number of virtual slots; the map, and all that is broadcast, has this many rows.
SLOTS = 4096
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key; null keys share one slot."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``virtual_slot`` of every row; a null text has no bytes."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       slot_of(F.col(id_col), slots).alias("virtual_slot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot``, ``bytes``, ``rows`` of all slots, the empty ones too."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def assign(sizes: DataFrame, shards: int) -> DataFrame:
    """Give every slot without a ``shard`` to the shard with the fewest bytes, large slots first.

    ``sizes``: ``virtual_slot``, ``bytes``, ``rows``, ``shard`` (null: free). One row folds the
    slots, whose number is fixed.
    """
    one = F.struct(F.col("bytes"), F.col("virtual_slot"), F.col("rows"))
    gathered = sizes.agg(
        F.array_sort(F.collect_list(F.when(F.col("shard").isNull(), one)),
                     lambda a, b: F.when(a["bytes"] != b["bytes"], F.when(a["bytes"] > b["bytes"], -1).otherwise(1)).otherwise(a["virtual_slot"] - b["virtual_slot"])).alias("free"),
        *[F.coalesce(F.sum(F.when(F.col("shard") == i, F.col("bytes"))), F.lit(0)).alias(f"load{i}") for i in range(shards)])
    start = F.struct(F.array(*[f"load{i}" for i in range(shards)]).alias("loads"), F.array().cast("array<int>").alias("shards"))

    def give(state: Column, slot: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(F.transform(state["loads"], lambda x, i: x + F.when(i == least, slot["bytes"]).otherwise(F.lit(0))).alias("loads"),
                        F.concat(state["shards"], F.array(least)).alias("shards"))

    given = gathered.select(F.explode(F.arrays_zip("free", F.aggregate("free", start, give)["shards"].alias("shard"))).alias("x"))
    given = given.select("x.free.virtual_slot", "x.free.bytes", "x.free.rows", F.col("x.shard").alias("shard"))
    return sizes.where(F.col("shard").isNotNull()).select("virtual_slot", "bytes", "rows", "shard").unionByName(given)


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: ``virtual_slot``, ``bytes``, ``rows``, ``shard``, ``version``."""
    return assign(sizes.withColumn("shard", F.lit(None).cast("int")), shards).withColumn("version", F.lit(1))


def rebalance(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for new sizes or another number of shards; slots within a shard's share stay."""
    now = sizes.join(F.broadcast(old.select("virtual_slot", "shard", "version")), "virtual_slot")
    held = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    share = F.sum("bytes").over(Window.partitionBy()) / shards
    stays = (F.col("shard") < shards) & (F.col("held") <= F.col("share"))
    freed = now.withColumn("held", held).withColumn("share", share).withColumn("shard", F.when(stays, F.col("shard")))
    version = old.agg((F.max("version") + 1).cast("int").alias("version"))
    return assign(freed.select("virtual_slot", "bytes", "rows", "shard"), shards).crossJoin(F.broadcast(version))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the stored maps."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    kinds = "virtual_slot int, bytes long, rows long, shard int, version int"
    return spark.read.schema(kinds).parquet(path).where(F.col("version") == version)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with their ``shard`` and their ``slot``: the place within the shard, gapless from 0.

    The places of a shard run through its virtual slots, so no window holds more than one virtual
    slot, and the running counts are over the map alone. Rows with equal ids, sizes and texts take
    neighbouring places.
    """
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = slot_map.select("virtual_slot", "shard", before.alias("offset"))
    order = Window.partitionBy("virtual_slot").orderBy(*[c for c in rows.columns if c != "virtual_slot"])
    ranked = rows.withColumn("place", F.row_number().over(order))
    return ranked.join(F.broadcast(offsets), "virtual_slot").withColumn("slot", (F.col("offset") + F.col("place") - 1).cast("long")).drop("offset", "place")
