"""Bags, vectors and pairs of a row each say what tables of a row a token say."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import matcher as M
from kindred.operators import packed, vectors
from kindred.operators import pairs as P

TEXTS = [(0, "The lens, the LENS: É 5x"), (1, None), (2, ""), (3, "..."), (4, "cap of the lens"), (4, "lens cap Cap"), (5, "strap a b"), (6, "the strap"), (7, "cap cap cap lens"), (8, "strap b b"), (9, "unseen-word only")]


@pytest.fixture(scope="module")
def made(spark):
    texts = spark.createDataFrame(TEXTS, "id bigint, t string")
    counts = vectors.counts(vectors.token_rows(texts, "id", "t"))
    vocabulary = vectors.vocabulary(vectors.document_frequency(counts.where("token not in ('unseen', 'word', 'only')")), 10, 5.0).cache()
    return texts, counts, packed.bags(texts, "id", "t"), vocabulary


def rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_bags_are_counts(made):
    texts, counts, bags, _ = made
    assert rows(packed.token_counts(bags), "spec_id", "token", "n") == rows(counts, "spec_id", "token", "n")
    assert rows(packed.document_frequency(bags), "token", "df") == rows(vectors.document_frequency(counts), "token", "df")
    single = packed.bags(texts.where("id <> 4"), "id", "t")
    assert rows(packed.token_counts(single), "spec_id", "token", "n") == rows(counts.where("spec_id <> 4"), "spec_id", "token", "n")
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    assert packed.token_counts(packed.bags(texts.where("false"), "id", "t")).count() == 0


@pytest.mark.parametrize("tfidf", [True, False])
def test_features_scores_and_gradients(spark, made, tfidf):
    _, counts, bags, vocabulary = made
    words = packed.Words(vocabulary, tfidf)
    wide, flat = packed.vectors(bags, words), vectors.vectors(counts, vocabulary, tfidf)
    assert rows(packed.vector_rows(wide, words), "spec_id", "position", "x") == rows(flat, "spec_id", "position", "x")
    known = spark.createDataFrame([(0, 4, 1), (4, 7, 0), (5, 6, 1), (2, 0, 0), (0, 99, 1), (2, 3, 1)], "spec1 bigint, spec2 bigint, relation int")
    features = vectors.pair_features(known, flat)
    pairs = packed.joined(known.withColumnRenamed("relation", "y"), wide)
    expected = features.groupBy("spec1", "spec2").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("x").alias("largest"))
    columns = ["spec1", "spec2", "n", "total", "largest"]
    assert rows(packed.summed(pairs, words), *columns) == rows(expected, *columns)
    unpacked = packed.rows(pairs, words).select("spec1", "spec2", F.inline(F.arrays_zip("positions", "xs")).alias("position", "x"))
    assert rows(unpacked, "spec1", "spec2", "position", "x") == rows(features, "spec1", "spec2", "position", "x")
    w = np.arange(words.size) % 7 - 3.0
    weights = spark.createDataFrame(list(enumerate(w.tolist())), "position bigint, w double")
    scored = M.linear_scores(features, weights, known, 0.1)
    assert rows(packed.scores(pairs, words, w, 0.1), "spec1", "spec2", "p") == rows(scored, "spec1", "spec2", "p")
    slow = M.gradient(features, scored.join(known.withColumnRenamed("relation", "y"), ["spec1", "spec2"]), 0.5)
    assert rows(packed.gradient(pairs, words, w, 0.1, 0.5), "position", "delta") == rows(slow, "position", "delta")


@pytest.mark.parametrize("chunk", [2, 100])
def test_scores_of_blocks(spark, made, monkeypatch, chunk):
    monkeypatch.setattr(packed, "CHUNK", chunk)
    _, counts, bags, vocabulary = made
    words = packed.Words(vocabulary)
    specs = spark.range(10).select(F.col("id").alias("spec_id"), (F.col("id") % 2).alias("b"))
    seen = spark.createDataFrame([(4, 0), (1, 3), (5, 7)], "spec1 bigint, spec2 bigint")
    w = np.arange(words.size) % 7 - 3.0
    found = packed.block_scores(specs, ["b"], packed.vectors(bags, words), words, w, 0.1, seen)
    pairs = spark.createDataFrame([(x, y) for x, y in combinations(range(10), 2) if x % 2 == y % 2 and (x, y) not in {(0, 4), (1, 3), (5, 7)}], "spec1 bigint, spec2 bigint")
    weights = spark.createDataFrame(list(enumerate(w.tolist())), "position bigint, w double")
    expected = M.linear_scores(vectors.pair_features(pairs, vectors.vectors(counts, vocabulary)), weights, pairs, 0.1)
    assert rows(found, "spec1", "spec2", "p") == rows(expected, "spec1", "spec2", "p")
    assert rows(P.candidates(specs, ["b"], seen), "spec1", "spec2") == rows(pairs, "spec1", "spec2")
