"""Bags, vectors and pairs of specs with one row each, so that a spec's tokens are never shuffled one by one.

A bag is counted within its row, a vector is places in the vocabulary with counts, and a pair meets both vectors by two joins of specs. Features, scores and
gradients are made of a batch of pairs at a time. The vocabulary lies in each Python worker, as weights do: MAX_WEIGHTS tokens at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import pairs as P

#: Texts or pairs that are taken at once.
ROWS = 500
#: Specs of a block that are scored against others at once; their features lie side by side.
CHUNK = 1 << 7
SIDES = ("p1", "n1", "p2", "n2")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            yield batch.slice(lo, ROWS)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def _bag(texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
    """The distinct tokens of each text, in order, and how often each occurs."""
    words = pc.split_pattern_regex(pc.fill_null(pc.ascii_lower(texts), ""), text.SEPARATORS)
    doc = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = pc.list_flatten(words).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    tokens = coded.dictionary.take(order)
    key = doc * max(1, len(tokens)) + rank[coded.indices.to_numpy(zero_copy_only=False)]
    if len(tokens) and tokens[0].as_py() == "":
        key = key[key % len(tokens) != 0]
    key, n = np.unique(key, return_counts=True)
    size = np.bincount(key // max(1, len(tokens)), minlength=len(words))
    return _lists(size, tokens.take(pa.array(key % max(1, len(tokens))))), _lists(size, pa.array(n, pa.int32()))


def bags(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(spec_id, tokens, ns): the distinct tokens of each spec, in order, and how often each occurs. A row a spec; texts that share an identifier are one."""
    named = texts.select(F.col(id_col).alias("spec_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *_bag(part.column(1))], names=["spec_id", "tokens", "ns"])

    found = named.mapInArrow(run, f"spec_id {named.schema['spec_id'].dataType.simpleString()}, tokens array<string>, ns array<int>")
    if named.groupBy("spec_id").count().where("count > 1").isEmpty():
        return found
    one = token_counts(found).groupBy("spec_id", "token").agg(F.sum("n").cast("int").alias("n"))
    one = one.groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("token", "n"))).alias("t"))
    return one.select("spec_id", F.col("t.token").alias("tokens"), F.col("t.n").alias("ns"))


def token_counts(bags: DataFrame) -> DataFrame:
    """(spec_id, token, n) of bags, as vectors.counts gives it."""
    return bags.select("spec_id", F.inline(F.arrays_zip("tokens", "ns")).alias("token", "n")).withColumn("n", F.col("n").cast("long"))


def document_frequency(bags: DataFrame) -> DataFrame:
    """(token, df); a task sums up its bags first, in a table of its distinct tokens."""
    return bags.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


class Words:
    """A vocabulary in every worker: its tokens by position, and their idf, without which counts are the numbers (bag of words)."""

    def __init__(self, vocabulary: DataFrame, tfidf: bool = True):
        found = vocabulary.select("token", "position", "idf").toArrow().combine_chunks().sort_by("position")
        self.size = len(found)
        self.shared = vocabulary.sparkSession.sparkContext.broadcast((pa.chunked_array(found["token"]).combine_chunks() if len(found) else pa.array([], pa.string()), found["idf"].to_numpy() if tfidf else None))


def vectors(bags: DataFrame, words: Words) -> DataFrame:
    """(spec_id, positions, ns): the vocabulary's tokens of each spec that has any."""
    shared = words.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            tokens, ns = part.column(1), part.column(2)
            row = np.repeat(np.arange(len(part)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
            at = pc.fill_null(pc.index_in(pc.list_flatten(tokens), value_set=shared.value[0]), -1).to_numpy(zero_copy_only=False)
            known = at >= 0
            size = np.bincount(row[known], minlength=len(part))
            found = [part.column(0), _lists(size, pa.array(at[known], pa.int32())), _lists(size, pa.array(pc.list_flatten(ns).to_numpy(zero_copy_only=False)[known], pa.int32()))]
            yield pa.RecordBatch.from_arrays(found, names=["spec_id", "positions", "ns"]).filter(pa.array(size > 0))

    return bags.mapInArrow(run, f"spec_id {bags.schema['spec_id'].dataType.simpleString()}, positions array<int>, ns array<int>")


def _numbers(positions: pa.Array, ns: pa.Array, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, x) of the vectors of a batch; a null one has none."""
    row = np.repeat(np.arange(len(positions)), pc.fill_null(pc.list_value_length(positions), 0).to_numpy(zero_copy_only=False))
    at, n = (pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (positions, ns))
    if idf is None:
        return row, at.astype(np.int64), n.astype(float)
    return row, at.astype(np.int64), n / np.bincount(row, n, len(positions))[row] * idf[at]


def vector_rows(vecs: DataFrame, words: Words) -> DataFrame:
    """(spec_id, position, x), as vectors.vectors gives it."""
    shared = words.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            row, at, x = _numbers(part.column(1), part.column(2), shared.value[1])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at), pa.array(x)], names=["spec_id", "position", "x"])

    return vecs.mapInArrow(run, f"spec_id {vecs.schema['spec_id'].dataType.simpleString()}, position bigint, x double")


def joined(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """pairs with both specs' vectors; null where a spec has none."""
    side = lambda s: vecs.select(F.col("spec_id").alias(f"spec{s}"), F.col("positions").alias(f"p{s}"), F.col("ns").alias(f"n{s}"))
    return pairs.join(side(1), "spec1", "left").join(side(2), "spec2", "left").select(*pairs.columns, *SIDES)


def _features(part: pa.RecordBatch, size: int, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, x), in order: the absolute differences of the two vectors of each row of joined(), where they aren't 0."""
    column = lambda name: part.column(part.schema.get_field_index(name))
    (r1, p1, x1), (r2, p2, x2) = (_numbers(column(p), column(n), idf) for p, n in (SIDES[:2], SIDES[2:]))
    key, x = np.concatenate([r1 * size + p1, r2 * size + p2]), np.concatenate([x1, -x2])
    order = np.argsort(key, kind="stable")
    key, x = key[order], x[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    x = np.abs(np.add.reduceat(x, first)) if len(first) else x
    key = key[first][x != 0]
    return key // max(1, size), key % max(1, size), x[x != 0]


def over(pairs: DataFrame, words: Words, f: Callable[..., dict[str, pa.Array | np.ndarray]], ddl: str) -> DataFrame:
    """The columns of pairs, a table of joined(), and those of f(n, row, position, x, part), of ddl: f is given the features of n pairs at a time."""
    shared, size, kept = words.shared, words.size, [c for c in pairs.columns if c not in SIDES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            made = f(len(part), *_features(part, size, shared.value[1]), part)
            columns = {c: part.column(part.schema.get_field_index(c)) for c in kept} | made
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))

    return pairs.mapInArrow(run, ", ".join([*(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in kept), ddl]))


def summed(pairs: DataFrame, words: Words) -> DataFrame:
    """pairs with the number of their features, their total and the largest; without pairs that have none."""

    def f(n, row, at, x, part):
        largest = np.zeros(n)
        np.maximum.at(largest, row, x)
        return {"n": np.bincount(row, minlength=n), "total": np.bincount(row, x, n), "largest": largest}

    return over(pairs, words, f, "n bigint, total double, largest double").where("n > 0")


def rows(pairs: DataFrame, words: Words) -> DataFrame:
    """pairs with (positions, xs), as matcher.rows has them."""
    return over(pairs, words, lambda n, row, at, x, part: {"positions": _lists(c := np.bincount(row, minlength=n), pa.array(at)), "xs": _lists(c, pa.array(x))}, "positions array<bigint>, xs array<double>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def scores(pairs: DataFrame, words: Words, weights: np.ndarray, bias: float) -> DataFrame:
    """pairs with p, the sigmoid of the sum of weight * x and the bias."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    return over(pairs, words, lambda n, row, at, x, part: {"p": _sigmoid(np.bincount(row, shared.value[at] * x, n) + bias)}, "p double")


def gradient(pairs: DataFrame, words: Words, weights: np.ndarray, bias: float, rate: float) -> DataFrame:
    """(position, delta): the sum over pairs, which have their label in y, of rate * (p - y) * x, at every position that has a feature. A task sums up its pairs first."""
    shared, held = words.shared, pairs.sparkSession.sparkContext.broadcast(weights)
    size = words.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, there = np.zeros(size), np.zeros(size, bool)
        for part in _parts(batches):
            row, at, x = _features(part, size, shared.value[1])
            p = _sigmoid(np.bincount(row, held.value[at] * x, len(part)) + bias)
            error = p - part.column(part.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            total += np.bincount(at, rate * error[row] * x, size)
            there[at] = True
        at = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["position", "g"])

    return pairs.mapInArrow(run, "position bigint, g double").groupBy("position").agg(F.sum("g").alias("delta"))


def _sides(lists: pa.Array, field: str) -> pa.Array:
    return lists.field(lists.type.get_field_index(field))


def block_scores(specs: DataFrame, block: list[str], vecs: DataFrame, words: Words, weights: np.ndarray, bias: float, seen: DataFrame | None = None) -> DataFrame:
    """(spec1, spec2, p) of candidates(specs, block, seen). A vector travels once for every CHUNK specs of its block, and pairs are made where both vectors are."""
    known = specs.select("spec_id", *block).join(vecs, "spec_id", "left")
    met = P.met(known, block, ["positions", "ns"], seen, CHUNK).where("not __same or size(__left) > 1").select("__left", "__right", "__same")
    shared, held, kind = words.shared, specs.sparkSession.sparkContext.broadcast(weights), specs.schema["spec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                left, right, same = pc.list_flatten(one.column(0)), pc.list_flatten(one.column(1)), one.column(2)[0].as_py()
                sides = [_numbers(_sides(s, "positions"), _sides(s, "ns"), shared.value[1]) for s in (left, right)]
                there, place = np.unique(np.concatenate([s[1] for s in sides]), return_inverse=True)
                w, dense = held.value[there], []
                for (row, _, x), at, s in zip(sides, np.split(place, [len(sides[0][1])]), (left, right)):
                    dense.append(np.zeros((len(s), len(there))))
                    dense[-1][row, at] = x
                ids = [_sides(s, "spec_id").to_pylist() for s in (left, right)]
                column = {y: k for k, y in enumerate(ids[1])}
                out = []
                for k, (x, not_these) in enumerate(zip(ids[0], _sides(left, "seen").to_pylist())):
                    at = np.array([j for j, y in enumerate(ids[1]) if x < y] if same else range(len(ids[1])), np.int64)
                    if not_these:
                        at = np.setdiff1d(at, [j for j, y in enumerate(ids[1]) if y in set(not_these)] if len(column) < len(ids[1]) else [column[y] for y in not_these if y in column])
                    if len(at):
                        p = _sigmoid(np.abs(dense[1][at] - dense[0][k]) @ w + bias)
                        out += [(min(x, ids[1][j]), max(x, ids[1][j]), q) for j, q in zip(at.tolist(), p.tolist())]
                if out:
                    a, b, p = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, left.type.field("spec_id").type), pa.array(b, left.type.field("spec_id").type), pa.array(p)], names=["spec1", "spec2", "p"])

    return met.mapInArrow(run, f"spec1 {kind}, spec2 {kind}, p double")
