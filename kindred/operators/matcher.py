"""The pair matcher: logistic regression in mini-batches, its scores, and self-training.

Weights lie on the driver as one vector of the vocabulary's size, at most MAX_WEIGHTS; features stay distributed, one row a
pair. A batch is one pass over its rows that sums gradients by position before anything is sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import log_loss, sigmoid
from ..shared import Shared
from . import pairs as P
from .ranks import shuffled_rank
from .vectors import pair_features

EPOCHS, BATCH, RATE, PATIENCE, STEP, MOST_NEW, MAX_WEIGHTS = 200, 2000, 1e-4, 5, 0.15, 500_000, 10_000_000
#: Features (16 bytes each) that one task trains on alone; beyond, each batch is a job of its own over its rows. The result is the same but for the order of sums.
ONE_TASK = 20_000_000


@dataclass
class Matcher:
    weights: np.ndarray
    bias: float = 0.0
    learning_rate: float = RATE
    mode: str = "tfidf"

    @classmethod
    def new(cls, size: int, learning_rate: float = RATE, mode: str = "tfidf", seed: int | None = None) -> Matcher:
        """Zeros, or uniform numbers of [0, 1) by the seed."""
        if size > MAX_WEIGHTS:
            raise ValueError(f"a vocabulary of {size} tokens is too large for the driver; prune it by idf")
        rng = np.random.default_rng(seed)
        return cls(np.zeros(size) if seed is None else rng.random(size), 0.0 if seed is None else float(rng.random()), learning_rate, mode)


def rows(features: DataFrame, pairs: DataFrame, batch: int = BATCH) -> DataFrame:
    """(spec1, spec2, y, batch, positions, xs) of every pair, those without a feature too, in batches of a seeded order."""
    sparse = features.groupBy("spec1", "spec2").agg(F.collect_list("position").alias("positions"), F.collect_list("x").alias("xs"))
    joined = pairs.select("spec1", "spec2", F.col("relation").alias("y")).join(sparse, ["spec1", "spec2"], "left")
    keyed = joined.withColumn("__k", F.concat_ws("\x01", F.col("spec1").cast("string"), F.col("spec2").cast("string")))
    placed = shuffled_rank(keyed, "__k", name="batch").drop("__k").withColumn("batch", F.expr(f"batch div {batch}"))
    return placed.withColumns({"positions": F.coalesce("positions", F.array().cast("array<bigint>")), "xs": F.coalesce("xs", F.array().cast("array<double>"))})


def max_delta(before: Matcher, after: Matcher) -> float:
    """The largest change of a weight."""
    return float(np.abs(before.weights - after.weights).max(initial=0.0))


def weight_rows(spark: SparkSession, m: Matcher) -> DataFrame:
    """(position, w), the bias at position -1; MAX_WEIGHTS rows at most."""
    return spark.createDataFrame([(-1, float(m.bias)), *((i, float(w)) for i, w in enumerate(m.weights))], "position bigint, w double")


def linear_scores(features: DataFrame, weights: DataFrame, pairs: DataFrame, bias: float) -> DataFrame:
    """(spec1, spec2, p): sigmoid of the sum of w * x and the bias, by joins alone. weights: (position, w)."""
    sums = features.join(weights, "position").groupBy("spec1", "spec2").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    return pairs.select("spec1", "spec2").distinct().join(sums, ["spec1", "spec2"], "left").select("spec1", "spec2", sigmoid(F.coalesce("s", F.lit(0.0)) + F.lit(bias)).alias("p"))


def gradient(features: DataFrame, scored: DataFrame, rate: float) -> DataFrame:
    """(position, delta): the sum over pairs of rate * (p - y) * x. scored: (spec1, spec2, y, p)."""
    return features.join(scored, ["spec1", "spec2"]).groupBy("position").agg(F.sum(F.lit(rate) * (F.col("p") - F.col("y")) * F.col("x")).alias("delta"))


def _scores(b: pd.DataFrame, m: Matcher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = b["positions"].map(len).to_numpy(np.int64)
    row = np.repeat(np.arange(len(b)), n)
    at = np.concatenate([*b["positions"], np.zeros(0)]).astype(np.int64)
    x = np.concatenate([*b["xs"], np.zeros(0)]).astype(float)
    z = np.bincount(row, m.weights[at] * x, len(b)) + m.bias
    return row, at, x, np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), 1 - 1 / (1 + np.exp(-np.abs(z))))


def predict(data: DataFrame, m: Matcher) -> DataFrame:
    """(spec1, spec2, y, p) of rows()."""
    shared = data.sparkSession.sparkContext.broadcast(m)  # MAX_WEIGHTS numbers at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["spec1", "spec2", "y"]].assign(p=_scores(b, shared.value)[3])

    kind = data.schema["spec1"].dataType.simpleString()
    return data.mapInPandas(run, f"spec1 {kind}, spec2 {kind}, y int, p double")


def step(data: DataFrame, m: Matcher) -> tuple[Matcher, float]:
    """The matcher after one batch, and the largest change of a weight."""
    shared = data.sparkSession.sparkContext.broadcast(m)  # MAX_WEIGHTS numbers at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        total, bias = np.zeros(len(w.weights)), 0.0
        for b in batches:
            row, at, x, p = _scores(b, w)
            error = p - b["y"].to_numpy()
            total += np.bincount(at, error[row] * x, len(total))
            bias += error.sum()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"position": np.append(at, -1), "g": np.append(total[at], bias)})

    sums = data.mapInPandas(run, "position bigint, g double").groupBy("position").agg(F.sum("g").alias("g")).toPandas()
    shared.unpersist()
    delta = np.zeros(len(m.weights))
    inner = sums[sums["position"] >= 0]
    delta[inner["position"]] = m.learning_rate * inner["g"]
    return replace(m, weights=m.weights - delta, bias=m.bias - m.learning_rate * float(sums.loc[sums["position"] < 0, "g"].sum())), float(np.abs(delta).max(initial=0.0))


def mean_loss(scored: DataFrame) -> float | None:
    return scored.agg(F.avg(log_loss(F.col("p"), F.col("y")))).first()[0]


def rising(losses: list[float], patience: int = PATIENCE) -> bool:
    """Whether the last `patience` steps never lowered the loss."""
    return len(losses) > patience and all(a <= b for a, b in zip(losses[-patience - 1 : -1], losses[-patience:]))


def _batch(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Row of each feature, its position and value, and the labels."""
    n = b["positions"].map(len).to_numpy(np.int64)
    return np.repeat(np.arange(len(b)), n), np.concatenate([*b["positions"], np.zeros(0)]).astype(np.int64), np.concatenate([*b["xs"], np.zeros(0)]).astype(float), b["y"].to_numpy(float)


def _probability(rows: tuple[np.ndarray, ...], w: np.ndarray, bias: float) -> np.ndarray:
    row, at, x, y = rows
    z = np.bincount(row, w[at] * x, len(y)) + bias
    small = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + small), small / (1 + small))


def _fit_in_one_task(train: DataFrame, test: DataFrame, m: Matcher, full: list[int], epochs: int, patience: int) -> Matcher:
    """fit, of at most ONE_TASK features: steps follow each other anyway, and a batch is too small to be shared out."""
    shared = train.sparkSession.sparkContext.broadcast(m)  # MAX_WEIGHTS numbers at most
    columns = ["spec1", "spec2", "batch", "y", "positions", "xs"]
    both = train.where(F.col("batch").isin(full)).select(F.lit(True).alias("train"), *columns).union(test.select(F.lit(False), *columns))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([*parts, pd.DataFrame({"train": [], "batch": [], "y": [], "positions": [], "xs": [], "spec1": [], "spec2": []})])
        held = held.sort_values(["batch", "spec1", "spec2"], kind="stable")
        mine = held[held["train"] == True]  # noqa: E712
        batches, held_out = [_batch(g) for _, g in mine.groupby("batch")], _batch(held[held["train"] == False])  # noqa: E712
        now = shared.value
        w, bias, rate = now.weights.copy(), now.bias, now.learning_rate
        kept, losses = [], []
        for _ in range(epochs):
            for rows_ in batches:
                error = _probability(rows_, w, bias) - rows_[3]
                w = w - rate * np.bincount(rows_[1], error[rows_[0]] * rows_[2], len(w))
                bias -= rate * error.sum()
            kept = [*kept[-patience:], (w, bias)]
            p, y = _probability(held_out, w, bias), held_out[3]
            losses.append(float(-np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-15)).mean()) if len(y) else 0.0)
            if rising(losses, patience):
                w, bias = kept[0]
                break
        yield pd.DataFrame({"weights": [w], "bias": [bias]})

    found = both.repartition(1).mapInPandas(run, "weights array<double>, bias double").first()
    shared.unpersist()
    return replace(m, weights=np.array(found["weights"], float), bias=found["bias"])


def fit(train: DataFrame, test: DataFrame, m: Matcher, epochs: int = EPOCHS, patience: int = PATIENCE) -> Matcher:
    """m trained on the full batches of train (its only one, if there is none that is full), until the mean loss on test rises for `patience` epochs; then the matcher before the rise."""
    work = Shared(train.sparkSession, "matcher")
    sizes = {r["batch"]: r["count"] for r in train.groupBy("batch").count().collect()}
    # Rows of a batch lie together, so that a step's scan reads the row groups of its batch alone.
    train, test = work.written(train.repartitionByRange("batch").sortWithinPartitions("batch"), "train"), work.written(test, "test")
    full = sorted(b for b, n in sizes.items() if n == max(sizes.values()))
    features = train.union(test).agg(F.sum(F.size("positions"))).first()[0] or 0
    if features <= ONE_TASK:
        return _fit_in_one_task(train, test, m, full, epochs, patience)
    kept, losses = [], []
    for _ in range(epochs):
        for b in full:
            m, _ = step(train.where(F.col("batch") == b), m)
        kept = [*kept[-patience:], m]
        losses.append(mean_loss(predict(test, m)) or 0.0)
        if rising(losses, patience):
            return kept[0]
    return m


def f1(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row (tp, fp, fn, tn, f1) of (y, p); f1 is null where nothing is or is found positive."""
    hit = F.col("p") >= threshold
    c = scored.agg(*[F.count_if(a & (F.col("y") == y)).alias(n) for n, a, y in (("tp", hit, 1), ("fp", hit, 0), ("fn", ~hit, 1), ("tn", ~hit, 0))])
    return c.withColumn("f1", F.try_divide(F.lit(2.0) * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.select("spec1", "spec2", "y", "p", ((F.col("p") >= threshold).cast("int") == F.col("y")).alias("correct"))


def user_report(scored: DataFrame) -> DataFrame:
    """(spec1, spec2, p) of pairs whose label isn't known."""
    return scored.select("spec1", "spec2", "p")


def confident(scored: DataFrame, t: float) -> DataFrame:
    """(spec1, spec2, relation): pairs of p < t as 0 and of p > 1 - t as 1."""
    return scored.where((F.col("p") < t) | (F.col("p") > 1 - t)).select("spec1", "spec2", (F.col("p") >= t).cast("int").alias("relation"))


def unclosed(pairs: DataFrame) -> DataFrame:
    """The pairs that follow from chains of pairs of relation 1 and aren't among them."""
    ids = pairs.select(F.col("spec1").alias("spec_id")).union(pairs.select("spec2")).distinct()
    whole = P.similar_pairs(P.cliques(ids, pairs))
    known = pairs.select(F.least("spec1", "spec2").alias("spec1"), F.greatest("spec1", "spec2").alias("spec2"))
    return whole.join(known, ["spec1", "spec2"], "left_anti")


def self_train(members: DataFrame, block: DataFrame, labelled: DataFrame, test: DataFrame, vecs: DataFrame, m: Matcher, step_size: float = STEP, most: int = MOST_NEW, epochs: int = EPOCHS, batch: int = BATCH) -> tuple[Matcher, DataFrame]:
    """The matcher and all pairs after rounds at t = 0, step_size, ... below 0.5: train on what is there, score the unseen pairs of specs
    that are in no clique and agree in block's columns, and add the confident ones, `most` a round in the order of identifiers.
    """
    if not [c for c in block.columns if c != "spec_id"]:
        raise ValueError("block needs a column: without one, every spec would be paired with every other")
    work = Shared(labelled.sparkSession, "self-training")
    specs = block.join(P.singletons(members), "spec_id", "left_semi")
    columns = [c for c in block.columns if c != "spec_id"]
    pairs, held, at, t = work.written(labelled.select("spec1", "spec2", "relation"), "pairs0"), rows(pair_features(test, vecs), test, batch), 0, 0.0
    while t < 0.5:
        m = fit(rows(pair_features(pairs, vecs), pairs, batch), held, m, epochs)
        unseen = P.candidates(specs, columns, pairs).withColumn("relation", F.lit(None).cast("int"))
        new = confident(predict(rows(pair_features(unseen, vecs), unseen, batch), m), t).orderBy("spec1", "spec2").limit(most)
        at, t = at + 1, t + step_size
        pairs = work.written(pairs.union(new), f"pairs{at}")
    return m, pairs
