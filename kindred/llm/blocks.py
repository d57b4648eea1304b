"""Blocks of tokenised documents, and global questions that they ask about 64- or 128-bit keys.

Documents lie in blocks of about a million words, one row each, as compressed numpy bytes in a written table. A block sends each
of its distinct keys once to the worker that owns the key's range; that worker merges what it gets and answers every block that
asked: which keys are shared, how often a key occurs, its rank among all keys. A key that occurs in a billion places arrives once
from each block, so hot words, hot sources and large groups of copies make no hot worker.

Records travel by digits: with up to `FAN` ** r workers a record takes r exchanges, each of which sets one digit of the worker it is
at, so a worker sends `FAN` rows at most in each, and the rows of an exchange grow with the corpus and not with its square.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shared
from .words import words

BLOCK_WORDS = 1 << 20
WORKER_KEYS = 2 << 20
FAN = 256
BLOCK = "block bigint, n_words bigint, doc_ids binary, lengths binary, vocabulary binary, tokens binary"
ROUTED = "worker bigint, source bigint, data binary"
U = np.uint64
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).reshape(-1).view(np.uint8).data)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _planes(a: np.ndarray) -> bytes:
    """a, its numbers' first bytes before their second ones and so on, so that leading zeros compress to nothing."""
    return pack(a.view(np.uint8).reshape(-1, a.itemsize).T)


def _unplaned(b: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers of one length, each as its differences: sorted and constant ones come to little."""
    size = len(columns[0])
    planes = np.empty((8, len(columns), size), np.uint8)
    step = np.empty(size, U)
    for i, c in enumerate(columns):
        c = c.astype(U, copy=False)
        step[:1] = c[:1]
        np.subtract(c[1:], c[:-1], out=step[1:])
        planes[:, i] = step.view(np.uint8).reshape(-1, 8).T
    return pack(planes)


def _unpacked_to(b: bytes, columns: np.ndarray) -> None:
    planes = unpack(b, np.uint8).reshape(8, *columns.shape)
    for i, column in enumerate(columns):
        step = np.ascontiguousarray(planes[:, i].T).view(U).ravel()
        np.cumsum(step, out=column)


def joined_columns(blobs: list[bytes], n: int) -> list[np.ndarray]:
    """The columns of all blobs on end; each is unpacked to its place, so nothing is held twice."""
    sizes = [zstandard.frame_content_size(b) // (8 * n) for b in blobs]
    out, at = np.empty((n, sum(sizes)), U), 0
    for b, size in zip(blobs, sizes):
        _unpacked_to(b, out[:, at : at + size])
        at += size
    return list(out)


def unpack_columns(b: bytes, n: int) -> list[np.ndarray]:
    return joined_columns([b], n)


def each_row(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """A batch's rows, one held at a time."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]
        give_back()


def blobs_of(column: pa.ChunkedArray) -> list[pa.Buffer]:
    """The values of a binary column where they lie."""
    return [x.as_buffer() for x in column]


def give_back() -> None:
    """Freed memory goes back to the system; else workers that wait for their next task keep what the last one took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _pack_tokens(t: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct tokens, frequent ones first, and each token's place among them."""
    found = pa.array(t).dictionary_encode()  # by a hash table, which is quicker than a sort
    u, place = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(-np.bincount(place, minlength=len(u)), kind="stable")
    rank = np.empty(len(u), np.uint32)
    rank[order] = np.arange(len(u))
    return pack(u[order]), _planes(rank[place])


def rows(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


_BLOCK = {"block": pa.int64(), "n_words": pa.int64(), "doc_ids": pa.binary(), "lengths": pa.binary(), "vocabulary": pa.binary(), "tokens": pa.binary()}
_ROUTED = {"worker": pa.int64(), "source": pa.int64(), "data": pa.binary()}


def _block(number: int, ids: list, lengths: list, tokens: list) -> pa.RecordBatch:
    n = np.concatenate(lengths)
    vocabulary, places = _pack_tokens(np.concatenate(tokens))
    return rows(_BLOCK, block=[number], n_words=[int(n.sum())], doc_ids=[pack(np.concatenate(ids))], lengths=[pack(n)], vocabulary=[vocabulary], tokens=[places])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, lengths, tokens, held = [], [], [], 0
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            w = words(part.column(1))
            ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            lengths.append(np.diff(w.first))
            tokens.append(w.hashes)
            held += len(w.hashes)
            if held >= BLOCK_WORDS:
                yield _block(number, ids, lengths, tokens)
                number += 1
                ids, lengths, tokens, held = [], [], [], 0
                give_back()
    if ids:
        yield _block(number, ids, lengths, tokens)
    ids, lengths, tokens = [], [], []
    give_back()


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as blocks. Rows without an identifier are left out: no result could name them. A null text has no words."""
    return docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_build, BLOCK)


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks, whose numbers are partition * 2**32 + place, numbered 0, 1, ... without gaps. One number a partition goes to the driver."""
    sizes = blocks.groupBy(F.shiftright("block", 32).alias("p")).count().collect()
    first, at = {}, 0
    for p, n in sorted((r["p"], r["count"]) for r in sizes):
        first[p] = at
        at += n
    starts = blocks.sparkSession.createDataFrame(list(first.items()) or [(0, 0)], "p bigint, base bigint")
    named = blocks.withColumn("p", F.shiftright("block", 32)).join(F.broadcast(starts), "p")  # a row a partition
    return named.withColumn("block", F.col("base") + F.col("block").bitwiseAND((1 << 32) - 1)).select(*blocks.columns)


def grouped(sizes: dict[int, int]) -> dict[int, int]:
    """For each block, of so many words, the number of the larger one that it goes to: neighbours together, up to BLOCK_WORDS."""
    out, n, held = {}, 0, 0
    for block in sorted(sizes):
        if held and held + sizes[block] > BLOCK_WORDS:
            n, held = n + 1, 0
        held += sizes[block]
        out[block] = n
    return out


def worker_count(blocks: int, keys: int) -> int:
    return max(1, blocks, -(-keys // WORKER_KEYS))


class Docs:
    """A block, unpacked: tokens, and of each token its document's place in the block and its own place in the document."""

    def __init__(self, row: dict):
        self.ids, self.lengths = unpack(row["doc_ids"], np.int64), unpack(row["lengths"], np.int64)
        self.tokens = unpack(row["vocabulary"], U)[_unplaned(row["tokens"], np.uint32)]
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)

    def at(self) -> np.ndarray:
        return np.arange(len(self.tokens)) - self.first[self.doc]

    def left(self) -> np.ndarray:
        """How many of its document's tokens begin here or later."""
        return self.first[self.doc + 1] - np.arange(len(self.tokens))


def _ranked(a: np.ndarray) -> np.ndarray:
    """Ranks of numbers, from 1, equal ones alike."""
    order = np.argsort(a)
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.concatenate([[True], a[order][1:] != a[order][:-1]])[: len(a)])
    return out


def order_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The places of the keys (hi, lo) in ascending order, equal ones in any. Only keys of one hi are sorted by lo."""
    order = np.argsort(hi)
    if lo.any():
        h = hi[order]
        equal = h[1:] == h[:-1]
        tied = np.flatnonzero(np.append(equal, False) | np.insert(equal, 0, False))
        group = np.cumsum(np.insert(~equal, 0, False))[tied]
        at = order[tied]
        order[tied] = at[np.argsort(group << 32 | _ranked(lo[at]))]
    return order


def order_by(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """The places of pairs of whole numbers in ascending order, equal ones in any."""
    if len(major) and int(major.max()) < 1 << 31 and int(minor.max()) < 1 << 32:
        return np.argsort(major.astype(U) << U(32) | minor.astype(U))
    return np.lexsort((minor, major))


def _new(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of sorted keys: which differ from the one before."""
    out = np.ones(len(hi), bool)
    out[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return out


class Distinct:
    """The sorted distinct keys of a block, how often each occurs, which lie in two or more of its documents, and each key's place among them."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray):
        order = order_of(hi, lo)
        h, l, d = hi[order], lo[order], doc[order]
        new = _new(h, l)
        place = np.cumsum(new) - 1
        self.hi, self.lo = h[new], l[new]
        self.count = np.bincount(place, minlength=len(self.hi))
        self.several = np.zeros(len(self.hi), bool)
        self.several[place[1:][~new[1:] & (d[1:] != d[:-1])]] = True
        self.inverse = np.empty(len(hi), np.int64)
        self.inverse[order] = place


def uniform(workers: int) -> Callable[..., np.ndarray]:
    """The owner of a key whose upper half is a hash; owners' ranges rise with the key."""
    return lambda hi, *_: ((hi >> U(32)) * U(workers) >> U(32)).astype(np.int64)


def _text(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Keys as byte strings of the same order."""
    out = np.empty((len(hi), 2), ">u8")
    out[:, 0], out[:, 1] = hi, lo
    return out.view("S16").ravel()


def ranges(state: DataFrame, keys_of: Callable[[dict], tuple], workers: int) -> Callable[..., np.ndarray]:
    """The owner of a key by ranges that hold about equally many keys, cut at a sample of some 64 keys a worker, as Spark's own range partitioning does."""
    stride = max(1, WORKER_KEYS // 64)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                hi, lo, _ = keys_of(row)
                at = slice(row["block"] % stride % max(1, len(hi)), None, stride)
                yield pa.RecordBatch.from_arrays([pa.array([pack_columns(hi[at], lo[at])], pa.binary())], names=["data"])

    if workers == 1:
        return lambda hi, *_: np.zeros(len(hi), np.int64)
    hi, lo = joined_columns([r["data"] for r in state.mapInArrow(sample, "data binary").collect()], 2)
    keys = np.sort(_text(hi, lo))
    cuts = np.unique(keys[np.arange(1, workers) * len(keys) // workers]) if len(keys) else keys
    upper = np.frombuffer(cuts.tobytes(), ">u8").astype(U)[::2]

    def owner(hi: np.ndarray, lo: np.ndarray, *_) -> np.ndarray:
        out = np.searchsorted(upper, hi, "right")
        at = np.flatnonzero(np.searchsorted(upper, hi, "left") < out)  # lo decides
        out[at] = np.searchsorted(cuts, _text(hi[at], lo[at]), "right")
        return out

    return owner


def routed(records: DataFrame, width: int, to: Callable[..., np.ndarray], workers: int) -> DataFrame:
    """Rows (worker, source, data) whose records, of `width` columns, lie with the workers that `to` says of them. records: the same, anywhere. source: the last sender."""
    rounds, fan = 1, 2  # the least fan with which the fewest exchanges do
    while FAN**rounds < workers:
        rounds += 1
    while fan**rounds < workers:
        fan += 1

    def cut(worker: int, columns: list[np.ndarray], place: int) -> pa.RecordBatch:
        digit = (to(*columns) // place % fan).astype(np.uint16)  # which numpy sorts by its digits
        order = np.argsort(digit, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(digit[order])) + 1, len(order)) if len(order) else []
        base, out, lo = worker - worker // place % fan * place, [], 0
        for hi in ends:
            at = order[lo:hi]
            out.append((base + int(digit[at[0]]) * place, pack_columns(*(c[at] for c in columns))))
            lo = hi
        return rows(_ROUTED, worker=[w for w, _ in out], source=[worker] * len(out), data=[d for _, d in out])

    top = fan ** (rounds - 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                yield cut(row["worker"] % fan**rounds, unpack_columns(row["data"], width), top)

    records = records.mapInArrow(first, ROUTED)
    def onward(place: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("source")
            out = pa.Table.from_batches([cut(table["worker"][0].as_py(), joined_columns(blobs_of(table["data"]), width), place)])
            give_back()
            return out

        return run

    for r in range(1, rounds):
        records = records.groupBy("worker").applyInArrow(onward(fan ** (rounds - 1 - r)), ROUTED)
    return records


#: A question's record: key in two halves, twice its place among its block's keys and whether several of the block's documents have it, block, occurrences.
_ASKED = 5


class Answers:
    """What the workers say: a written table of (worker, source, data), and the names that workers before each one have given."""

    def __init__(self, table: DataFrame, base: np.ndarray, names: int):
        self.table, self.base, self.names = table, base, names


def ask(work: Shared, name: str, state: DataFrame, keys_of: Callable[[dict], tuple], workers: int, reply: str, to: Callable[..., np.ndarray] | None = None, blocks: int = 0) -> Answers:
    """Asks about keys_of(row), (hi, lo, document) of a block's keys in any order, for every row of state.

    A key is shared if two or more documents of all blocks have it. reply: "shared" answers for shared keys alone, "all" for all;
    an answer is a name: with "all" the key's rank, from 1, among all keys (in their order if `to` keeps it), with "shared" its worker and its rank there;
    with "count" it is how often the key occurs, and with "keeper" (for shared keys alone) 1, or 2 to the first block that has it.
    blocks: how many there are, if they may be more than the workers.
    """
    to = to or uniform(workers)

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                d = Distinct(*keys_of(row))
                if len(d.hi):
                    data = pack_columns(d.hi, d.lo, np.arange(len(d.hi)) * 2 + d.several, np.full(len(d.hi), row["block"]), d.count)
                    yield rows(_ROUTED, worker=[row["block"]], source=[row["block"]], data=[data])

    def answer(table: pa.Table) -> pa.Table:
        me = table["worker"][0].as_py()
        hi, lo, tag, block, count = joined_columns(blobs_of(table.sort_by("source")["data"]), _ASKED)
        order = order_of(hi, lo)
        new = _new(hi[order], lo[order])
        place = np.cumsum(new) - 1
        total = np.zeros(place[-1] + 1, np.int64)
        np.add.at(total, place, count[order].astype(np.int64))
        shared = np.ones(len(total), bool)
        if reply in ("shared", "keeper"):
            shared = np.zeros(len(total), bool)
            shared[place[~new]] = True
            shared[place[(tag[order] & U(1)).astype(bool)]] = True
        said = total if reply == "count" else np.cumsum(shared)
        said = said[place]
        if reply == "keeper":
            first = np.full(len(total), np.iinfo(np.int64).max)
            np.minimum.at(first, place, block[order].astype(np.int64))
            said = 1 + (block[order].astype(np.int64) == first[place])
        on = np.flatnonzero(shared[place])
        at = order[on]
        by = order_by(block[at], tag[at])
        at, said = at[by], said[on[by]]
        data = pack_columns(block[at], tag[at] >> U(1), said, np.full(len(at), me))
        del hi, lo, tag, block, count, order, place, at, by, on
        give_back()
        return pa.table({"worker": pa.array([me, -1 - me], pa.int64()), "source": pa.array([me, int(shared.sum())], pa.int64()), "data": pa.array([data, b""], pa.binary())})

    asked = routed(state.mapInArrow(questions, ROUTED), _ASKED, to, workers)
    answers = work.written(asked.groupBy("worker").applyInArrow(answer, ROUTED), f"{name}-answers")
    base = np.zeros(workers, np.int64)
    if reply == "all":
        for r in answers.where("worker < 0").select("worker", "source").collect():  # one number a worker
            base[-1 - r["worker"]] = r["source"]
    before = np.arange(workers) << 32 if reply == "shared" else np.cumsum(base) - base
    return Answers(routed(answers.where("worker >= 0"), 4, lambda block, *_: block.astype(np.int64), max(workers, blocks)), before, int(base.sum()))


def heard(state: DataFrame, answers: Answers, f: Callable[[dict, np.ndarray, np.ndarray], dict], schema: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """The next state: f(row, places, what is said) of each block of state, places being those among its sorted distinct keys."""
    base = answers.base

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        _, place, said, worker = joined_columns(blobs_of(right.sort_by("source")["data"]), 4)
        found = [f(row, place.astype(np.int64), said.astype(np.int64) + base[worker.astype(np.int64)]) for row in each_row(left)]
        return pa.table({k: pa.array([x[k] for x in found], t) for k, t in schema.items()})

    return state.groupBy("block").cogroup(answers.table.withColumnRenamed("worker", "block").groupBy("block")).applyInArrow(both, ddl)


def said_of(n: int, place: np.ndarray, said: np.ndarray) -> np.ndarray:
    """What is said of each of n keys; 0 where nothing is."""
    out = np.zeros(n, np.int64)
    out[place] = said
    return out


def said_each(keys: tuple, place: np.ndarray, said: np.ndarray) -> np.ndarray:
    """What is said of each of a block's keys, in their own order."""
    d = Distinct(*keys)
    return said_of(len(d.hi), place, said)[d.inverse]


SPANS = "doc_id bigint, start_word bigint, end_word bigint, n_words bigint"


def spans_table(ids: np.ndarray, first: np.ndarray, doc: np.ndarray, hit: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Spans that the windows of `length` words from `hit` (rising) cover. doc: each one's document; ids, first: the documents' identifiers and first words."""
    if not len(hit):
        return {k: np.zeros(0, np.int64) for k in ("doc_id", "start_word", "end_word", "n_words")}
    begin = np.concatenate([[True], (hit[1:] > hit[:-1] + length) | (doc[1:] != doc[:-1])])
    end = np.concatenate([begin[1:], [True]])
    start, stop = hit[begin] - first[doc[begin]], hit[end] + length - first[doc[end]]
    return {"doc_id": ids[doc[begin]], "start_word": start, "end_word": stop, "n_words": stop - start}
