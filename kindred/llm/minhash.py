"""Near-duplicates by an inverted join of MinHash signatures (operator 3).

A signature has a coordinate for each of `coordinates` hash functions: the least hash of the document's word shingles. Every
coordinate-value pair is a posting list, whose length a first round counts. Prefix: two signatures that agree in `matches` coordinates
agree in one of the coordinates - matches + 1 shortest of a document's lists, so a document is posted under these alone, and the long
lists of documents that share little are never merged. Skip: collisions with the long lists are counted for the members of a short
one alone, by probing their signatures, and a short list that is long within its worker is cut once more, by the lists within
it: its members meet only in the shortest of those. Documents of one signature are posted as one.

near_duplicate_pairs retains every pair above the threshold. Groups need less: near_duplicates compares the first document left of
a list with all others; those that match join its tree and are skipped from then on. So each list gives a forest that connects exactly
what its matching pairs connect, and a group of n documents n - 1 edges rather than n * (n - 1) / 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..shared import Shared
from .blocks import _ROUTED, ROUTED, Distinct, U, ask, blobs_of, each_row, give_back, joined_columns, numbered, pack, pack_columns, routed, rows, said_each, uniform, unpack, unpack_columns, worker_count
from .words import mix, windows, words

COORDINATES, MATCHES, SHINGLE = 64, 32, 3
_SIG = {"block": pa.int64(), "n_docs": pa.int64(), "doc_ids": pa.binary(), "signatures": pa.binary()}
SIG = "block bigint, n_docs bigint, doc_ids binary, signatures binary"
#: A block's keys are 64 times its documents, and a task that asks or posts holds a dozen numbers for each.
BLOCK_DOCS = 1 << 13
#: Signatures that a worker of posting lists is sent at most, as the hashes of keys spread them.
POSTED = 1 << 17
#: A posting list of more rows is cut by the lists within it.
LONG = 256


def signatures(hashes: np.ndarray, first: np.ndarray, coordinates: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures of the documents that have words, and which these are. Shorter than a shingle: all their words are one."""
    n = np.diff(first)
    has = np.flatnonzero(n > 0)
    if not len(has):
        return np.zeros((0, coordinates), np.uint32), has
    w = np.concatenate([windows(hashes, shingle), np.zeros(min(shingle - 1, len(hashes)), np.uint64)])[: len(hashes)]
    doc = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(hashes)) + shingle <= first[doc + 1]
    short = np.flatnonzero((n > 0) & (n < shingle))
    for d in short:  # at most shingle - 1 words
        x = np.array([first[d + 1] - first[d]], np.uint64)
        for h in hashes[first[d] : first[d + 1]]:
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h)
        w[first[d]], inside[first[d]] = x[0], True
    x, d = w[inside], doc[inside]
    at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    multipliers = mix(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(at), coordinates), np.uint32)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 15), "right")) - 1)
        end = at[hi] if hi < len(at) else len(x)
        part, cut = x[at[lo] : end], at[lo:hi] - at[lo]
        for c in range(coordinates):
            out[lo:hi, c] = np.minimum.reduceat((part * multipliers[c]) >> np.uint64(32), cut)
        lo = hi
    return out, has


def _keys(sig: np.ndarray) -> np.ndarray:
    return mix(sig.astype(np.uint64) + (np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32)))


def _read(row: dict, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    return unpack(row["doc_ids"], np.int64), unpack(row["signatures"], np.uint32).reshape(-1, coordinates)


def _leaders(ids: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct signature, and for each row its leader."""
    _, first, inverse = np.unique(np.ascontiguousarray(sig).view(np.dtype((np.void, sig.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    return first, first[inverse.ravel()]


def _equal(sig: np.ndarray, row: int, others: np.ndarray) -> np.ndarray:
    return np.concatenate([(sig[others[i : i + 4096]] == sig[row]).sum(1) for i in range(0, len(others), 4096)]) if len(others) else np.zeros(0, np.int64)


def _signed(blobs: list, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records, identifiers and signatures of all blobs, unpacked one at a time to their places."""
    sizes = [zstandard.frame_content_size(b) // (8 * wide) for b in blobs]
    n, at = sum(sizes), 0
    known, ids, halves = np.empty(n, U), np.empty(n, U), np.empty((n, wide - 3), U)
    for b, size in zip(blobs, sizes):
        part = slice(at, at + size)
        _, known[part], ids[part], *columns = unpack_columns(b, wide)
        for i, c in enumerate(columns):
            halves[part, i] = c
        at += size
    return known, ids, halves.view(np.uint32)


Found = tuple[list[int], list[int], list[int]]


def forest(sig: np.ndarray, matches: int) -> Found:
    """Edges between the rows of one posting list, and their matches, that connect what its matching pairs connect."""
    left, a, b, m = np.arange(len(sig)), [], [], []
    frontier: list[int] = []
    while len(left):
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
        p = frontier.pop()
        same = _equal(sig, p, left)
        hit = same >= matches
        new = left[hit].tolist()
        a += [p] * len(new)
        b += new
        m += same[hit].tolist()
        frontier += new
        left = left[~hit]
    return a, b, m


def every_pair(sig: np.ndarray, matches: int) -> Found:
    """All pairs of the rows of one posting list that match, and their matches."""
    a, b, m = [], [], []
    for p in range(len(sig) - 1):
        same = _equal(sig, p, np.arange(p + 1, len(sig)))
        hit = np.flatnonzero(same >= matches)
        a += [p] * len(hit)
        b += (hit + p + 1).tolist()
        m += same[hit].tolist()
    return a, b, m


def _lists(keys: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each row's n shortest lists, where another row has them too. Ties in the order of the keys, the same everywhere."""
    order = np.lexsort((keys, count), axis=1)[:, :n]
    row, at = np.repeat(np.arange(len(keys)), order.shape[1]), order.ravel()
    posted = count[row, at] > 1
    return row[posted], keys[row[posted], at[posted]]


def _compared(key: np.ndarray, doc: np.ndarray, sig: np.ndarray, matches: int, way: Callable[..., Found], cut: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, matches) of the rows of sig that meet in posting lists (key, doc)."""
    by = np.lexsort((doc, key))
    key, doc = key[by], doc[by]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    a, b, m = [], [], []
    two = begin[size == 2]
    for lo in range(0, len(two), 1 << 16):
        p, q = doc[two[lo : lo + (1 << 16)]], doc[two[lo : lo + (1 << 16)] + 1]
        same = (sig[p] == sig[q]).sum(1)
        for out, x in ((a, p), (b, q), (m, same)):
            out.append(x[same >= matches])
    seen: set[bytes] = set()
    for lo, n in zip(begin[size > 2], size[size > 2]):
        members = doc[lo : lo + n]
        if (mark := members.tobytes()) in seen:
            continue
        seen.add(mark)
        if cut and n > LONG:
            own = sig[members]
            keys = _keys(own)
            d = Distinct(keys.ravel(), np.zeros(keys.size, U), np.zeros(keys.size, np.int64))
            row, k = _lists(keys, d.count[d.inverse].reshape(keys.shape), sig.shape[1] - matches + 1)
            p, q, same = _compared(k, row, own, matches, way, False)
        else:
            p, q, same = (np.array(x, np.int64) for x in way(sig[members], matches))
        for out, x in ((a, members[p]), (b, members[q]), (m, same)):
            out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, m))


def posting_workers(blocks: int, docs: int, lists: int) -> int:
    """Workers for posting lists: a document's signature may go to as many of them as it has lists, so they grow with both."""
    return max(1, blocks, -(-docs * lists // POSTED))


def _edges(work: Shared, docs: DataFrame, coordinates: int, matches: int, shingle: int, id_col: str, text_col: str, way: Callable[..., Found]) -> DataFrame:
    """(doc_a, doc_b, matches), doc_a < doc_b: what `way` finds in the lists; documents of one signature are linked to the first of them in their block."""
    if not 1 <= matches <= coordinates:
        raise ValueError("matches must lie between 1 and coordinates")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, sigs, held = [], [], 0
        block = lambda: rows(_SIG, block=[number], n_docs=[held], doc_ids=[pack(np.concatenate(ids))], signatures=[pack(np.concatenate(sigs))])
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                if held and held + len(part) > BLOCK_DOCS:
                    yield block()
                    number += 1
                    ids, sigs, held = [], [], 0
                    give_back()
                w = words(part.column(1))
                sig, has = signatures(w.hashes, w.first, coordinates, shingle)
                ids.append(part.column(0).to_numpy(zero_copy_only=False)[has].astype(np.int64))
                sigs.append(sig)
                held += len(sig)
        if held:
            yield block()
        ids, sigs = [], []
        give_back()

    named = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    raw = work.written(named.mapInArrow(sign, SIG), "signatures")
    n_blocks, total = raw.agg(F.count("*"), F.sum("n_docs")).first()
    blocks, workers = numbered(raw), worker_count(n_blocks, (total or 0) * coordinates)

    def leaders(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, sig = _read(row, coordinates)
        lead, leader = _leaders(ids, sig)
        return ids, sig, lead, leader

    def keys_of(row: dict) -> tuple:
        _, sig, lead, _ = leaders(row)
        hi = _keys(sig[lead]).ravel()
        return hi, np.zeros(len(hi), U), np.repeat(np.arange(len(lead), dtype=np.int32), coordinates)

    counts = ask(work, "counts", blocks, keys_of, workers, "count")
    workers = posting_workers(n_blocks, total or 0, coordinates - matches + 1)
    owner = uniform(workers)

    def post(left: pa.Table, right: pa.Table) -> pa.Table:
        """Postings (kind 0), the signatures that a worker needs for them (kind 1), and links between rows of one signature (kind 2)."""
        out = []
        _, place, said, _ = joined_columns(blobs_of(right["data"]), 4)
        for row in each_row(left):
            ids, sig, lead, leader = leaders(row)
            other = np.flatnonzero(leader != np.arange(len(ids)))
            out.append((2, row["block"], pack_columns(ids[leader[other]], ids[other])))
            sig = sig[lead]
            keys = _keys(sig)
            count = said_each((keys.ravel(), np.zeros(keys.size, U), np.zeros(keys.size, np.int32)), place.astype(np.int64), said.astype(np.int64)).reshape(keys.shape)
            doc, key = _lists(keys, count, coordinates - matches + 1)
            record = row["block"] << 32 | doc
            out.append((0, row["block"], pack_columns(key, record)))
            need = np.unique(owner(key) * len(lead) + doc) if len(doc) else np.zeros(0, np.int64)
            del keys, count, key, record
            to, doc = need // max(1, len(lead)), need % max(1, len(lead))
            cuts = np.flatnonzero(np.diff(to)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(to))) if len(to) else ():
                d = doc[lo:hi]
                halves = np.ascontiguousarray(np.pad(sig[d], ((0, 0), (0, coordinates % 2)))).view(U)
                out.append((1, int(to[lo]), pack_columns(to[lo:hi], row["block"] << 32 | d, ids[lead][d], *halves.T)))
        return pa.table({"kind": pa.array([k for k, _, _ in out], pa.int32()), "worker": pa.array([w for _, w, _ in out], pa.int64()), "source": pa.array([w for _, w, _ in out], pa.int64()), "data": pa.array([d for _, _, d in out], pa.binary())})

    asked = blocks.groupBy("block").cogroup(counts.table.withColumnRenamed("worker", "block").groupBy("block"))
    posted = work.written(asked.applyInArrow(post, "kind int, " + ROUTED), "postings")
    work.dropped("counts-answers")
    work.dropped("signatures")
    wide = 3 + (coordinates + 1) // 2

    def pairs(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> pa.Table:
        e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), m], 1)[a != b], axis=0)
        return pa.table({"doc_a": e[:, 0], "doc_b": e[:, 1], "matches": e[:, 2].astype(np.int32)})

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        key, record = joined_columns(blobs_of(left["data"]), 2)
        known, ids, sig = _signed(blobs_of(right["data"]), wide)
        sig = sig[:, :coordinates]
        by = np.argsort(known)
        a, b, m = _compared(key, by[np.searchsorted(known[by], record)] if len(record) else np.zeros(0, np.int64), np.ascontiguousarray(sig), matches, way)
        ids = ids.view(np.int64)
        found = pairs(ids[a], ids[b], m)
        del sig, known
        give_back()
        return found

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                a, b = (x.view(np.int64) for x in joined_columns([data], 2))
                yield from pairs(a, b, np.full(len(a), coordinates)).to_batches()

    edge = "doc_a bigint, doc_b bigint, matches int"
    lists = routed(posted.where("kind = 0").select("worker", "source", "data"), 2, lambda key, *_: owner(key), workers)
    # Signatures are wide and don't compress, so they go straight to their worker: a row for each block and worker, never more rows than signatures.
    needed = posted.where("kind = 1").select("worker", "source", "data")
    met = lists.groupBy("worker").cogroup(needed.groupBy("worker")).applyInArrow(merge, edge)
    return met.union(posted.where("kind = 2").select("data").mapInArrow(linked, edge)).distinct()


def near_duplicate_pairs(docs: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_a, doc_b, matches), doc_a < doc_b, of signatures that agree in at least `matches` coordinates.

    Every matching pair of two different signatures is there, for the first document of each signature in a block of documents; further documents of a
    signature are paired with that first one only. Rows without an identifier and texts without a word (null and empty ones) are in no
    pair. Rows that share an identifier are one document to whoever reads the pairs, and no pair. Texts may be of any length; equal
    numbers of matches are no tie, as nothing is ranked. Other columns are ignored; an empty table gives no pair.
    """
    return _edges(Shared(docs.sparkSession, "minhash"), docs, coordinates, matches, shingle, id_col, text_col, every_pair)


def near_duplicates(docs: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id): documents of a group of near-duplicates and the group's smallest identifier, which stays and has no row.

    A group is a connected component of near_duplicate_pairs' pairs; what it says of nulls, empty and long texts and repeated identifiers holds here.
    """
    pairs = _edges(Shared(docs.sparkSession, "minhash"), docs, coordinates, matches, shingle, id_col, text_col, forest)
    return connected_components(pairs, "doc_a", "doc_b", "doc_id", "keep_id").where("doc_id <> keep_id")
