"""Running totals, row numbers and look-back over ordered groups of any size.

A plain window sends a whole group to one task. These operators cut every group into slots that
follow its order, work inside the slots, and carry one total row per slot forward. A hot group
is then spread over as many tasks as it has slots, and only slot totals meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.session import stage

SLOT_ROWS = 65_536
_SLOT = "_slot"


def position_slot(position: Column, rows: int = SLOT_ROWS) -> Column:
    """Slot for rows that already carry a dense number: never more than ``rows`` rows each."""
    return F.floor(position / F.lit(rows)).cast("long")


def time_slot(ts: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def running(df: DataFrame, group: list[str], slot: Column, order: list[Column],
            sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums and maxima per group, the current row included."""
    sums, maxima = sums or {}, maxima or {}
    cut = df.withColumn(_SLOT, slot)
    for name, value in {**sums, **maxima}.items():
        cut = cut.withColumn(f"_in_{name}", value)
    inside = Window.partitionBy(*group, _SLOT).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    local = cut
    for name in sums:
        local = local.withColumn(name, F.sum(f"_in_{name}").over(inside))
    for name in maxima:
        local = local.withColumn(name, F.max(f"_in_{name}").over(inside))
    totals = cut.groupBy(*group, _SLOT).agg(
        *[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_t_{n}") for n in maxima],
    )
    carry = totals.select(
        *group, _SLOT,
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxima],
    )
    done = local.join(carry, [*group, _SLOT])
    for name in sums:
        done = done.withColumn(name, F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
    for name in maxima:
        done = done.withColumn(name, F.greatest(F.col(name), F.col(f"_c_{name}")))
    return done.select(*df.columns, *sums, *maxima)


def numbered(df: DataFrame, group: list[str], slot: Column, order: list[Column], name: str) -> DataFrame:
    """Dense row number per group, from 1."""
    return running(df, group, slot, order, sums={name: F.lit(1).cast("long")})


def numbered_by_range(df: DataFrame, group: list[str], order: list[str], name: str,
                      partitions: int | None = None) -> DataFrame:
    """Row number when the order key has no natural slot, such as a URL.

    Range partitioning splits a hot group at its own order keys. The partition number is written
    with the rows, so both uses below see the same cut. Without a number of ``partitions`` small
    neighbours are put together, which keeps their order.
    """
    keys = [F.col(c) for c in (*group, *order)]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    cut = stage(dealt.withColumn("_part", F.spark_partition_id().cast("long")))
    return numbered(cut, group, F.col("_part"), [F.col(c) for c in order], name).drop("_part")


def previous(df: DataFrame, group: list[str], slot: Column, order: list[str], values: list[str],
             prefix: str = "prev_") -> DataFrame:
    """Values of the row before, per group; NULL on the first row."""
    cut = df.withColumn(_SLOT, slot)
    inside = Window.partitionBy(*group, _SLOT).orderBy(*order)
    packed = F.struct(*values)
    local = cut.withColumn("_near", F.lag(packed).over(inside))
    last = cut.groupBy(*group, _SLOT).agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    carry = last.select(*group, _SLOT, F.lag("_last").over(
        Window.partitionBy(*group).orderBy(_SLOT)).alias("_far"))
    done = local.join(carry, [*group, _SLOT]).withColumn("_before", F.coalesce("_near", "_far"))
    return done.select(*df.columns, *[F.col(f"_before.{v}").alias(f"{prefix}{v}") for v in values])


def first_occurrence(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order. An aggregate, so copies fold before the shuffle."""
    rest = [c for c in df.columns if c not in group]
    packed = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*group).agg(packed.alias("_row")).select(*group, "_row.*").select(*df.columns)


def last_occurrence(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in group]
    packed = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*group).agg(packed.alias("_row")).select(*group, "_row.*").select(*df.columns)
