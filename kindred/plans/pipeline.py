"""The two ways in: train a matcher from specs and labelled pairs, and predict pairs with what training wrote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json
from ..operators import matcher as M
from ..operators import pairs as P
from ..operators import vectors
from ..shared import Shared
from ..sources import files


@dataclass
class Trained:
    """A matcher with its vocabulary, the pairs it was made from, its report on pairs held out, and their F1 (null where nothing is or is found similar)."""

    matcher: M.Matcher
    vocabulary: DataFrame
    pairs: DataFrame
    report: DataFrame
    f1: float | None


def token_counts(specs: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """(spec_id, token, n) over the values of the specs' string attributes."""
    return vectors.counts(vectors.token_rows(json.string_attributes(specs), "spec_id", "value", stopwords))


def train(
    spark: SparkSession,
    specs_path: str,
    labels_path: str,
    stopwords_path: str | None = None,
    mode: str = "tfidf",
    out: str | None = None,
    *,
    epochs: int = M.EPOCHS,
    batch: int = M.BATCH,
    rate: float = M.RATE,
    idf_max: float | None = vectors.IDF_MAX,
    self_training: bool = False,
    block: DataFrame | None = None,
) -> Trained:
    """Cliques of labelled pairs, their pairs in splits, a vocabulary of the specs in training pairs alone, a fit that tests on one half of the rest, and a report on the other.

    mode: "tfidf" (rare tokens above idf_max go) or "bow" (all tokens stay). out: a folder for vocabulary, model and pairs. self_training
    goes on with confident pairs of specs without a clique that agree in the columns of block (spec_id and others; by default the site).
    """
    if mode not in ("tfidf", "bow"):
        raise ValueError("mode is tfidf or bow")
    work = Shared(spark, "training")
    specs = work.written(files.read_specs(spark, specs_path), "specs")
    labels = work.written(files.read_labelled(spark, labels_path), "labels")
    members = work.written(P.cliques(specs, labels), "members")
    pairs = P.similar_pairs(members).union(P.different_pairs(members, P.different_roots(members, labels)))
    pairs = work.written(P.split(pairs), "pairs")
    of = lambda split: pairs.where(F.col("split") == split).drop("split")
    stopwords = files.read_stopwords(spark, stopwords_path) if stopwords_path else None
    counts = work.written(token_counts(specs, stopwords), "counts")
    frequency = work.written(vectors.document_frequency(P.in_pairs(counts, of("train"))), "frequency")
    tfidf = mode == "tfidf"
    vocabulary = work.written(vectors.vocabulary(frequency, specs.count(), idf_max if tfidf else None), "vocabulary")
    vecs = work.written(vectors.vectors(counts, vocabulary, tfidf), "vectors")
    rows = lambda p: M.rows(vectors.pair_features(p, vecs), p, batch)
    m = M.fit(rows(of("train")), rows(of("test")), M.Matcher.new(vocabulary.count(), rate, mode), epochs)
    known = pairs.drop("split")
    if self_training:
        block = specs.select("spec_id", "site") if block is None else block
        m, known = M.self_train(members, block, known, of("test"), vecs, m, epochs=epochs, batch=batch)
    held = work.written(M.predict(rows(of("validation")), m), "held")
    found = Trained(m, vocabulary, known, M.report(held), M.f1(held).first()["f1"])
    if out:
        files.write_vocabulary(vocabulary, f"{out}/vocabulary")
        files.write_model(spark, m, f"{out}/model")
        files.write_pairs(known, f"{out}/pairs")
    return found


def predict(spark: SparkSession, specs_path: str, pairs_path: str, vocabulary: str | DataFrame, model: str | M.Matcher) -> DataFrame:
    """(spec1, spec2, p) of unlabelled pairs. The model's mode says whether texts are counted or weighed by idf. model: a folder that train wrote, or a text file of lines.

    Pairs of unknown specs have the features of the known one.
    """
    if isinstance(vocabulary, str):
        vocabulary = files.read_vocabulary(spark, vocabulary)
    if isinstance(model, str):
        model = files.read_model_text(spark, model) if model.endswith((".csv", ".txt")) else files.read_model(spark, model)
    if vocabulary.count() != len(model.weights):
        raise ValueError("the model hasn't as many weights as the vocabulary has tokens")
    pairs = files.read_unlabelled(spark, pairs_path)
    ids = P.in_pairs(files.read_specs(spark, specs_path), pairs)
    vecs = Shared(spark, "prediction").written(vectors.vectors(token_counts(ids), vocabulary, model.mode == "tfidf"), "vectors")
    return M.user_report(M.predict(M.rows(vectors.pair_features(pairs, vecs), pairs), model))
