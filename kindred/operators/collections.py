"""Lists as arrays and sets as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nth(a: Column, n: int) -> Column:
    """The element at place n from 0, or from the end (-1 is the last); null beyond either end."""
    return F.try_element_at(a, F.lit(n + 1 if n >= 0 else n))


def split_at(a: Column, n: int) -> tuple[Column, Column]:
    return F.slice(a, 1, n), F.when(F.size(a) > n, F.slice(a, n + 1, F.size(a))).otherwise(F.slice(a, 1, 0))


def first_match(a: Column, predicate) -> Column:
    return nth(F.filter(a, predicate), 0)


def merge_sorted(a: Column, b: Column) -> Column:
    return F.array_sort(F.concat(a, b))


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def ordered_union(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """Two sorted tables as one, sorted."""
    return a.unionByName(b).orderBy(*order)


def scan(rows: DataFrame, order: list[str], descending: bool = True) -> DataFrame:
    """rows in the order of columns; the last first, as directories are read."""
    return rows.orderBy(*[F.desc(c) if descending else F.asc(c) for c in order])


def first_n(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n first rows in the order of columns."""
    return rows.orderBy(*order).limit(n)


def push(a: Column, x) -> Column:
    return F.array_prepend(a, x)


def push_list(a: Column, b: Column) -> Column:
    """a's elements before b's."""
    return F.concat(a, b)


def pop(a: Column) -> tuple[Column, Column]:
    """The first element (null of an empty list), and the others."""
    return nth(a, 0), F.when(F.size(a) > 1, F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))).otherwise(F.slice(a, 1, 0))


def set_in(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """rows with `member`: whether members has the key. A null key is no member."""
    marked = members.select(key).where(F.col(key).isNotNull()).distinct().withColumn("member", F.lit(True))
    return rows.join(marked, key, "left").withColumn("member", F.coalesce("member", F.lit(False)))


def map_get(m: Column, key) -> Column:
    return F.try_element_at(m, F.lit(key) if not isinstance(key, Column) else key)


def map_delete(m: Column, key) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def put_distinct(a: DataFrame, b: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """a and those rows of b whose key a doesn't have; of several rows of b with one key the first in the order of `order` (all columns, if none). Nulls are one key."""
    of = order or b.columns
    first = b.groupBy(key).agg(F.min(F.struct(*of, *[c for c in b.columns if c not in of])).alias("__first")).select(*[F.col("__first")[c].alias(c) for c in b.columns])
    known = a.select(F.col(key).alias("__key")).distinct()
    return a.union(first.join(known, F.col(key).eqNullSafe(F.col("__key")), "left_anti").select(a.columns))


def upserted(rows: DataFrame, key: str, default: int = 0, value: Column | None = None) -> DataFrame:
    """(key, value): the default at a key's first row, and after each further one what the mutator makes of it: one more, or, with `value`, the sum with
    those rows' values (any order of rows gives one result, as the mutator adds; the first row is the one of the smallest value).
    """
    if value is None:
        return rows.groupBy(key).agg((F.count("*") - 1 + default).alias("value"))
    return rows.withColumn("__v", value).groupBy(key).agg((F.sum("__v") - F.min("__v") + default).alias("value"))
