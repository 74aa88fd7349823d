"""Joins of a large table with a narrow one on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on salted keys: a hot key is shared by ``salts`` tasks, for as many copies of the narrow small side.

    ``spread`` is any evenly distributed value of the large side. The optimizer still broadcasts
    a small side of few bytes by its own threshold.
    """
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
