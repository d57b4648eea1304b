"""Nearest neighbours of every vector by stable projections in a kd-tree (operator 6).

Sun et al., "SRS: solving c-approximate nearest neighbor queries in high dimensional Euclidean space with a tiny index" (VLDB
2014). Vectors are projected to a few dimensions by Gaussians (2-stable: a projected squared distance over the true one is
chi-square with that many degrees of freedom), and the projections are indexed by a kd-tree. A query's projected neighbours come nearest first,
leaf by leaf, true distances of those are verified, and it stops once the chi-square test holds: at projected distance x and k-th best true distance d,
a point no farther than d would with probability `confidence` have turned up already.

The tree's upper part splits the vectors into cells, one task's work each; each cell is a smaller tree. A query first searches its own
cell. Its k-th distance then bounds which other cells the test still admits, and only those get it, once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Shared

#: SENT_MB: of queries for other cells that a task holds.
SENT_MB = 8
#: SAMPLE: vectors, projected, of which the driver makes the tree's upper part; CELL_SAMPLE a cell, if that is more.
K, DIMENSIONS, CONFIDENCE, CELL_ROWS, LEAF, SAMPLE, CELL_SAMPLE, SEED = 10, 12, 0.9, 4096, 128, 1 << 14, 8, 42
FOUND = "vec_id bigint, neighbour_id bigint, distance double"


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees of freedom <= x) = p."""

    def cdf(x: float) -> float:
        term = total = 1 / (m / 2)
        for n in range(1, 1000):
            term *= x / 2 / (m / 2 + n)
            total += term
            if term < total * 1e-15:
                break
        return total * math.exp(-x / 2 + m / 2 * math.log(x / 2) - math.lgamma(m / 2))

    lo, hi = 1e-12, 10.0 * m + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Splits:
    """A kd-tree's splits: node i's children are 2i + 1 and 2i + 2, the widest dimension is halved at its median."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.cut = np.zeros(2**depth - 1, np.int32), np.zeros(2**depth - 1)
        groups = [points]
        for level in range(depth):
            nxt = []
            for i, g in enumerate(groups):
                node = 2**level - 1 + i
                if len(g):
                    d = int(np.argmax(g.max(0) - g.min(0)))
                    c = float(np.median(g[:, d]))
                    self.dim[node], self.cut[node] = d, c
                    nxt += [g[g[:, d] < c], g[g[:, d] >= c]]
                else:
                    nxt += [g, g]
            groups = nxt

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] >= self.cut[node])
        return node - (2**self.depth - 1)


def _gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0) ** 2
    return out


class Cell:
    """The points of a cell in a kd-tree of leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, leaf: int = LEAF):
        order, stack, self.leaves = [], [np.arange(len(ids))], []
        while stack:
            g = stack.pop()
            if len(g) <= leaf:
                if len(g):
                    self.leaves.append((len(order) and sum(map(len, order)), len(g)))
                    order.append(g)
                continue
            d = int(np.argmax(projected[g].max(0) - projected[g].min(0)))
            g = g[np.argsort(projected[g, d], kind="stable")]
            stack += [g[: len(g) // 2], g[len(g) // 2 :]]
        at = np.concatenate(order)
        self.ids, self.vectors, self.projected = ids[at], vectors[at], projected[at]
        self.square = (self.vectors.astype(np.float64) ** 2).sum(1)
        self.near = (self.square / 2).astype(np.float32)
        self.low = np.array([self.projected[a : a + n].min(0) for a, n in self.leaves])
        self.high = np.array([self.projected[a : a + n].max(0) for a, n in self.leaves])

    def search(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, bound: np.ndarray, k: int, psi: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query its k best here (identifier, squared distance; infinite where none beats bound, the squared k-th distance so far).

        Step t takes each query to its t-th nearest leaf, until the chi-square test holds for the leaf's distance.
        """
        best = np.full((len(ids), k), np.inf)
        who = np.full((len(ids), k), np.iinfo(np.int64).max)
        gaps = _gap(projected, self.low, self.high)
        turn = np.argsort(gaps, axis=1, kind="stable")
        limit, going = bound.copy(), np.arange(len(ids))
        square = (vectors.astype(np.float64) ** 2).sum(1)
        half = (square + self.square.max(initial=0.0)) * 1e-5  # beyond the rounding of 32-bit products
        for t in range(len(self.leaves)):
            leaf = turn[going, t]
            on = gaps[going, leaf] <= psi * limit[going]
            going, leaf = going[on], leaf[on]
            if not len(going):
                break
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by])) + 1
            for q in np.split(going[by], cuts):
                a, n = self.leaves[turn[q[0], t]]
                # In 32 bits first: only those that may come among the k best so far are looked at closely.
                about = vectors[q] @ self.vectors[a : a + n].T
                least = ((square[q] - limit[q] - half[q]) / 2).astype(np.float32)[:, None] + self.near[None, a : a + n]
                row, column = np.nonzero(about >= least)
                true = ((vectors[q[row]].astype(np.float64) - self.vectors[a + column]) ** 2).sum(1)
                other = (self.ids[a + column] != ids[q[row]]) & (true <= limit[q[row]])
                row, column, true = row[other], column[other], true[other]
                if not len(row):
                    continue
                new = np.flatnonzero(np.bincount(row, minlength=len(q)))
                at = q[new]
                wide_true = np.full((len(new), n), np.inf)
                place = np.searchsorted(new, row)
                wide_true[place, column] = true
                most = int(np.bincount(place).max())
                if n > most + k:
                    few = np.argpartition(wide_true, most, axis=1)[:, : most + 1]
                else:
                    few = np.broadcast_to(np.arange(n), wide_true.shape)
                wide_true = np.take_along_axis(wide_true, few, 1)
                d = np.concatenate([best[at], wide_true], 1)
                w = np.concatenate([who[at], np.where(np.isinf(wide_true), np.iinfo(np.int64).max, self.ids[a + few])], 1)
                keep = np.lexsort((w, d), axis=1)[:, :k]
                best[at], who[at] = np.take_along_axis(d, keep, 1), np.take_along_axis(w, keep, 1)
                limit[at] = np.minimum(bound[at], best[at, -1])
        return who, best


def batches_of(found: Iterator[tuple], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, and four columns of bytes) in batches that end with the row with which they reach `most` bytes."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=["cell", "ids", "vectors", "projected", "bound"])

    for row in found:
        held.append(row)
        size += sum(map(len, row[1:]))
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


_ROW = "cell int, ids binary, vectors binary, projected binary"


def nearest_neighbours(vectors: DataFrame, k: int = K, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 1) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the approximately k nearest other vectors of every query, by Euclidean distance.

    Queries are the vectors whose identifier is divisible by `every`: all of them, unless it is given. They are searched for among all vectors.
    Each true neighbour is found with a probability of at least `confidence`, on average. Equal distances are ranked by identifier;
    repeated vectors are neighbours at distance 0, and rows that share an identifier aren't each other's neighbours. Rows whose identifier or vector is null,
    whose vector isn't as long as the most are, or that hold a null, NaN or infinite number, are left out. Fewer than k + 1 vectors: as many neighbours as there are. Other columns
    are ignored; an empty table gives no row.
    """
    if every < 1:
        raise ValueError("every must be positive")
    spark = vectors.sparkSession
    work = Shared(spark, "ann")
    identifier, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    source = vectors.where(identifier.isNotNull() & vector.isNotNull()).select(identifier.cast("long").alias("id"), vector.cast("array<float>").alias("v"))
    source = source.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = source.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes or not sizes[0]["n"]:
        return spark.createDataFrame([], "vec_id bigint, neighbour_id bigint, rank int, distance double")
    width, count = sizes[0]["n"], sizes[0]["count"]
    source = source.where(F.size("v") == width)
    m = min(dimensions, width)
    gauss = np.random.default_rng(seed).standard_normal((width, m))
    psi = chi_square_quantile(confidence, m)
    depth = max(0, math.ceil(math.log2(max(1, count / cell_rows))))
    matrix = lambda column: column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array([(matrix(b.column(0)).astype(np.float32) @ gauss).astype(np.float32).tobytes()], pa.binary())], names=["p"])

    sample = np.zeros((1, m))
    if depth:
        # Drawn by a hash of identifier and vector: rows that share an identifier are drawn each for itself.
        share = min(1.0, max(SAMPLE, CELL_SAMPLE << depth) / count)
        drawn = source.where(F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v")
        drawn = [np.frombuffer(r["p"], np.float32) for r in drawn.mapInArrow(project, "p binary").collect()]
        sample = np.concatenate([*drawn, np.zeros(m if not drawn else 0, np.float32)]).reshape(-1, m).astype(np.float64)
        sample = sample[np.lexsort(sample.T)]
    splits = Splits(sample, depth)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            ids, v = b.column(0).to_numpy(), matrix(b.column(1)).astype(np.float32)
            p = v @ gauss
            cell = splits.cell(p)
            by = np.argsort(cell, kind="stable")
            parts = np.split(by, np.flatnonzero(np.diff(cell[by])) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([cell[g[0]] for g in parts], pa.int32()), *(pa.array([x[g].tobytes() for g in parts], pa.binary()) for x in (ids, v, p))], names=["cell", "ids", "vectors", "projected"])

    def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        join = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        return join("ids", np.int64), join("vectors", np.float32).reshape(-1, width), join("projected", np.float64).reshape(-1, m)

    def whole(table: pa.Table) -> pa.Table:
        x = gathered(table)
        return pa.table({"cell": table["cell"][:1], **{n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("ids", "vectors", "projected"), x)}, "low": pa.array([x[2].min(0).tobytes()], pa.binary()), "high": pa.array([x[2].max(0).tobytes()], pa.binary())})

    cells = work.written(source.mapInArrow(assign, _ROW).groupBy("cell").applyInArrow(whole, _ROW + ", low binary, high binary"), "cells")
    boxes = sorted((r["cell"], r["low"], r["high"]) for r in cells.select("cell", "low", "high").collect())  # two corners a cell
    number = np.array([c for c, _, _ in boxes])
    low, high = (np.array([np.frombuffer(b[i], np.float64) for b in boxes]) for i in (1, 2))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's best in its own cell, and to which other cells it goes on."""
        for b in batches:
            for row in range(len(b)):
                t = pa.Table.from_batches([b.slice(row, 1)])
                ids, v, p = gathered(t)
                asks = ids % every == 0
                if not asks.any():
                    continue
                tree = Cell(ids, v, p)
                ids, v, p = ids[asks], v[asks], p[asks]
                here = t["cell"][0].as_py()
                for lo in range(0, len(ids), 2048):
                    q = slice(lo, lo + 2048)
                    who, best = tree.search(ids[q], v[q], p[q], np.full(len(ids[q]), np.inf), k, psi)
                    yield from batches_of(going(here, ids[q], v[q], p[q], who, best), SENT_MB << 20)

    def going(here: int, ids: np.ndarray, v: np.ndarray, p: np.ndarray, who: np.ndarray, best: np.ndarray) -> Iterator[tuple]:
        """Rows (cell, ids, vectors, projected, bound): what queries have found in their own cell, as cell -1, and queries for others."""
        yield -1, ids.tobytes(), who.tobytes(), best.tobytes(), b""
        for at in range(0, len(number), 1024):
            part = slice(at, at + 1024)
            goes = (_gap(p, low[part], high[part]) <= psi * best[:, -1:]) & (number[None, part] != here)
            for i in np.flatnonzero(goes.any(0)):
                g = np.flatnonzero(goes[:, i])
                yield int(number[at + i]), ids[g].tobytes(), v[g].tobytes(), p[g].tobytes(), best[g, -1].tobytes()

    first = work.written(cells.select("cell", "ids", "vectors", "projected").mapInArrow(own, _ROW + ", bound binary"), "first")

    def listed(ids: np.ndarray, who: np.ndarray, best: np.ndarray) -> pa.Table:
        ok = np.isfinite(best)
        return pa.table({"vec_id": np.repeat(ids, k)[ok.ravel()], "neighbour_id": who[ok], "distance": np.sqrt(best[ok])})

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from listed(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, k), np.frombuffer(r["projected"], np.float64).reshape(-1, k)).to_batches()

    def others(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [listed(np.zeros(0, np.int64), np.zeros((0, k), np.int64), np.zeros((0, k)))]
        if len(left) and len(right):
            tree = Cell(*gathered(left))
            # Those of many cells are searched for together, some 2048 at a time.
            before = np.cumsum([len(x.as_buffer()) // 8 for x in right["ids"]])
            ends = np.append(np.flatnonzero(np.diff(before // 2048)) + 1, len(right))
            for lo, hi in zip([0, *ends[:-1]], ends):
                part = right.slice(lo, hi - lo)
                ids, v, p = gathered(part)
                out.append(listed(ids, *tree.search(ids, v, p, np.frombuffer(b"".join(part["bound"].to_pylist()), np.float64), k, psi)))
        return pa.concat_tables(out)

    found = first.where("cell = -1").mapInArrow(unpacked, FOUND).union(cells.groupBy("cell").cogroup(first.where("cell >= 0").groupBy("cell")).applyInArrow(others, FOUND))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", "distance")
