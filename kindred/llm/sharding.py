"""A global shuffle into shards by a two-pass external shuffle (operator 9).

Pass 1 scatters records uniformly into buckets small enough for a task's memory, by a seeded hash; Spark's exchange writes
them to disk. Records that are equal in all columns have one hash, so each also draws a number by its place in its partition, and
copies scatter as well as other records do. Pass 2 holds one bucket at a time, puts it into a canonical order, Fisher-Yates shuffles it and writes it as a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, IntegerType, LongType, NullType, StructField, StructType

from .words import mix

BUCKET_BYTES = 24 << 20
SEED = 42


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0 .. n - 1: from the last place down, each is swapped with one drawn from those up to it."""
    order = list(range(n))
    draws = np.random.PCG64([seed, bucket]).random_raw(n).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = draws[i] * (i + 1) >> 64
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with two more columns, shard and position: their place in a seeded global shuffle. A partition is a shard.

    The number of buckets follows the bytes of all columns. A record's bucket is drawn from a hash of all its columns and, if
    equal rows come before it in its partition, their number: repeated rows, null identifiers and empty texts scatter like
    all others. So the result depends on the records, the seed and, for equal rows alone, on the partitions that they come in.
    Rows are never dropped, merged or changed, whatever is null, empty or long; ties in the canonical order are equal rows. Columns named shard and position are replaced; others may have any name. An empty table gives no row.
    """
    if seed < 0 or bucket_bytes < 1:
        raise ValueError("seed must not be negative and bucket_bytes must be positive")
    docs = docs.drop("shard", "position")
    columns = docs.columns
    of = lambda c: F.col(f"`{c}`")
    wide = [f.name for f in docs.schema if f.dataType.simpleString() in ("string", "binary")]
    other = [f.name for f in docs.schema if f.name not in wide and not isinstance(f.dataType, (AtomicType, NullType))]
    size = sum((F.coalesce(F.octet_length(of(c)).cast("long"), F.lit(0)) for c in wide), F.lit(8 * (len(columns) - len(wide))).cast("long"))
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(of(c)))).cast("long"), F.lit(0)) for c in other), size)
    n, total = docs.agg(F.count(F.lit(1)), F.sum(size)).first()
    buckets = max(1, -(-((total or 0) + 32 * n) // bucket_bytes))
    text = lambda c: F.to_json(F.struct(of(c))) if c in other else of(c).cast("string")
    # Of all columns: rows that a lost task's second run might number otherwise are equal, and it doesn't matter which goes where.
    key, tie = (F.xxhash64(F.lit(seed + i).cast("long"), *[F.coalesce(text(c), F.lit("\x00")) for c in columns]) for i in (0, 1))
    # Arrow's batches take columns by plain names alone, whatever docs calls them.
    plain = [f"c{i}" for i in range(len(columns))]
    keyed = docs.select(*[of(c).alias(p) for c, p in zip(columns, plain)], key.alias("key"), tie.alias("tie"), F.lit(0).alias("shard"))
    out = StructType([*docs.schema.fields, StructField("shard", IntegerType()), StructField("position", LongType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bucket of each record: its key's, if it is the first with it in the partition, else one drawn from the key and its number."""
        seen: dict[int, int] = {}  # keys by 8 bytes each, of one partition's records
        for b in batches:
            keys = b.column(len(columns)).to_numpy().view(np.uint64)
            number = np.zeros(len(keys), np.uint64)
            for i, k in enumerate(keys.tolist()):
                number[i] = seen[k] = seen.get(k, -1) + 1
            h = np.where(number > 0, mix(keys + number * np.uint64(0x9E3779B97F4A7C15)), keys)
            shard = (mix(h) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns) + 2], pa.array(shard)], names=[*plain, "key", "tie", "shard"])

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        if (shard := pc.unique(table.column(len(columns) + 2)).to_pylist())[1:]:
            raise RuntimeError("a partition holds several buckets")
        by = np.lexsort((table.column(len(columns) + 1).to_numpy(), table.column(len(columns)).to_numpy()))
        order = by[fisher_yates(len(table), seed, shard[0])]
        table = table.select([*range(len(columns)), len(columns) + 2]).rename_columns([*columns, "shard"])
        for lo in range(0, len(order), 2000):
            part = table.take(pa.array(order[lo : lo + 2000]))
            yield from part.append_column("position", pa.array(np.arange(lo, lo + len(part)), pa.int64())).combine_chunks().to_batches()

    return keyed.mapInArrow(draw, keyed.schema).repartitionById(buckets, F.col("shard")).mapInArrow(shuffle, out)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """shuffled(docs), each shard a Parquet file."""
    shuffled(docs, **options).write.parquet(path)
