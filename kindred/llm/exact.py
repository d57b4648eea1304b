"""Exact duplicates by a tree-merge of sorted digest runs (operator 10).

Each partition sorts its documents' digests into a run. In every round of a binomial exchange, workers whose numbers differ
in one digit (of base `fan`; 2 gives the plain binomial tree) split their runs at that digit of the digest, trade the parts, and each merges the `fan` sorted
parts it gets. Equal digests meet at some level; they are verified there by length and a second, independent hash, the smallest identifier goes
on, and the others are put down as lost. After the last round each worker owns a range of digests, so no root holds the
whole corpus. A digest enters a round once per worker at most, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Shared
from .blocks import pack, unpack

FAN = 8
#: A run's columns: SHA-256 in four parts, length in bytes, second hash, whether the identifier is null, identifier.
WIDTH = 8
_RUN = "worker bigint, run binary, lost binary"


def digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(F.col(f"`{text}`") if isinstance(text, str) else text, 256))


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores before it as no column of `columns` needs."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _sorted(run: np.ndarray) -> np.ndarray:
    return run[np.lexsort((np.ascontiguousarray(run[:, 7]).view(np.int64), *(run[:, c] for c in (6, 5, 4, 3, 2, 1, 0))))]


def _merged(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted runs: the rows with the smallest identifier of each text, and the others."""
    run = _sorted(np.concatenate(runs)) if runs else np.zeros((0, WIDTH), np.uint64)
    first = np.ones(len(run), bool)
    first[1:] = (run[1:, :6] != run[:-1, :6]).any(1)
    return run[first], run[~first]


def _array(b: bytes) -> np.ndarray:
    return unpack(b, np.uint64).reshape(-1, WIDTH)


def lost_rows(docs: DataFrame, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, keep_id) for each row whose text an earlier row has: rows are in the order of identifiers, null last."""
    if fan < 2:
        raise ValueError("fan must be at least 2")
    work = Shared(docs.sparkSession, "digests")
    text, number = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    source = docs.where(text.isNotNull()).select(
        digest(text_col).alias("digest"),
        F.octet_length(text).cast("long").alias("n"),
        F.xxhash64(text).alias("h"),
        number.isNull().cast("long").alias("nameless"),
        F.coalesce(number, F.lit(0).cast("long")).alias("id"),
    )

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            if len(batch):
                run = np.empty((len(batch), WIDTH), np.uint64)
                run[:, :4] = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(-1, 4)
                for c in (1, 2, 3, 4):
                    run[:, c + 3] = batch.column(c).to_numpy().view(np.uint64)
                parts.append(run)
        kept, lost = _merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pack(kept)], pa.binary()), pa.array([pack(lost)], pa.binary())], names=["worker", "run", "lost"])

    levels = [work.written(source.mapInArrow(start, _RUN), "level0")]
    workers = (levels[0].agg(F.max("worker")).first()[0] or 0) + 1
    rounds = 0
    while fan**rounds < workers:
        rounds += 1
    for r in range(rounds):

        def trade(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            place = fan ** (rounds - 1 - r)
            for batch in batches:
                for worker, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    run = _array(blob)
                    # The r-th digit of the digest's owner: the digest's upper half as a fraction of all workers.
                    digit = ((run[:, 0] >> np.uint64(32)) * np.uint64(fan**rounds) >> np.uint64(32)) // np.uint64(place) % np.uint64(fan)
                    base = worker - worker // place % fan * place
                    to = [(base + d * place, run[digit == d]) for d in range(fan)]
                    to = [(w, x) for w, x in to if len(x)]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in to], pa.int64()), pa.array([pack(x) for _, x in to], pa.binary())], names=["worker", "run"])

        def merge(table: pa.Table) -> pa.Table:
            kept, lost = _merged([_array(b) for b in table["run"].to_pylist()])
            return pa.table({"worker": table["worker"][:1], "run": pa.array([pack(kept)], pa.binary()), "lost": pa.array([pack(lost)], pa.binary())})

        levels.append(work.written(levels[-1].select("worker", "run").mapInArrow(trade, "worker bigint, run binary").groupBy("worker").applyInArrow(merge, _RUN), f"level{r + 1}"))

    def rows(column: str):
        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    run = _array(blob)
                    raw = np.ascontiguousarray(run[:, :4].astype(">u8")).tobytes()
                    number = [np.ascontiguousarray(run[:, c]).view(np.int64) for c in (4, 5, 7)]
                    ids = pa.array(number[2], pa.int64(), mask=run[:, 6] > 0)
                    yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(number[0]), pa.array(number[1]), ids], names=["digest", "n", "h", column])

        return unpacked

    lost = levels[0]
    for level in levels[1:]:
        lost = lost.union(level)
    lost = lost.select("lost").mapInArrow(rows("doc_id"), "digest binary, n bigint, h bigint, doc_id bigint")
    kept = levels[-1].select("run").mapInArrow(rows("keep_id"), "digest binary, n bigint, h bigint, keep_id bigint")
    return lost.join(kept, ["digest", "n", "h"]).select("digest", "doc_id", "keep_id")


def exact_duplicates(docs: DataFrame, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id) for every row whose text another row has too, but for the one with the smallest identifier, which stays.

    Texts are equal byte by byte: their SHA-256, length and a second hash agree. A null text equals nothing; empty texts
    equal each other. A null identifier counts as larger than all others (and stays if no other row has the text). A row that is there twice is
    listed as a copy of itself. Other columns are ignored; an empty table gives no row.
    """
    return lost_rows(docs, fan, id_col, text_col).select("doc_id", "keep_id")


def without_duplicates(docs: DataFrame, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates lists; of repeated rows, identifier and all, one stays.

    Columns may have any names, those used here too: helpers take names that docs doesn't have.
    """
    lost = lost_rows(docs, fan, id_col, text_col)
    lost = Shared(docs.sparkSession, "lost").written(lost, "rows")
    digest_, nameless, id_, twice_ = unused(docs.columns, "digest", "nameless", "id", "twice")
    number = F.col(f"`{id_col}`").cast("long")
    keys = [digest_, nameless, id_]
    helpers = {digest_: digest(text_col), nameless: number.isNull(), id_: F.coalesce(number, F.lit(0).cast("long"))}
    marked = docs.withColumns(helpers)
    mine = lambda x: x.select(F.col("digest").alias(digest_), F.col("doc_id").isNull().alias(nameless), F.coalesce("doc_id", F.lit(0)).alias(id_)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # The list grows with the corpus: both sides are sorted by key at every size, and no size is the first to do so.
    left = marked.join(mine(lost.where(~same)).hint("merge"), keys, "left_anti")
    twice = mine(lost.where(same)).withColumn(twice_, F.lit(True))
    if not twice.isEmpty():
        left = left.join(twice.hint("merge"), keys, "left")
        left = left.where(F.col(twice_).isNull()).union(left.where(F.col(twice_)).dropDuplicates(keys))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
select doc_id, keep_id from (
  select doc_id, min(doc_id) over w as keep_id, row_number() over (partition by text order by doc_id nulls last) as place
  from documents where text is not null window w as (partition by text))
where place > 1
"""
