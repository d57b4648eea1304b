"""Ranks over a whole table in two levels: rows in key buckets first, then the buckets' totals. No task sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: list[str], bucket: Column, name: str, partition: list[str] | None = None) -> DataFrame:
    """df with `name`: the place, from 0, of each row in the order of (bucket, order), within equal `partition` columns.

    bucket must rise with the order: a prefix of its first column, say. The buckets' totals, one row a bucket, are all that a single task ever sorts.
    """
    keys = partition or []
    df = df.withColumn("__b", bucket)
    totals = df.groupBy(*keys, "__b").count()
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)) - 1
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__b"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = df.withColumn("__place", place).alias("l").join(totals.alias("r"), on)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns if c != "__b"], (F.col("r.__before") + F.col("l.__place")).alias(name))


def shuffled_rank(df: DataFrame, key: str, seed: int = 42, name: str = "rank", partition: list[str] | None = None) -> DataFrame:
    """Places in a seeded random order without repeats, by a hash of the key; the same on every run."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return ranked(df.withColumn("__h", h), ["__h", key], F.substring("__h", 1, 3), name, partition).drop("__h")
