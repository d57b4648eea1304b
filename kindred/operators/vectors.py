"""Vocabulary and vectors, sparse: a row for each token of a spec."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .ranks import ranked

IDF_MAX = 8.692
FEW_WORDS = 100_000


def token_rows(texts: DataFrame, id_col: str, text_col: str, stopwords: list[str] | DataFrame | None = None) -> DataFrame:
    """(spec_id, token), as often as the token occurs. stopwords: words, or a table of `word` (as read_stopwords gives), which an anti join takes out."""
    found = texts.select(F.col(id_col).alias("spec_id"), F.explode(F.split(text.lower(F.col(text_col)), text.SEPARATORS)).alias("token")).where("token <> ''")
    if isinstance(stopwords, DataFrame):
        return without(found, stopwords)
    return found.where(~F.col("token").isin(stopwords)) if stopwords else found


def without(rows: DataFrame, stopwords: DataFrame) -> DataFrame:
    """rows without those whose token is a `word` of the table. A table of up to FEW_WORDS goes to every task, so that rows stay where they are."""
    words = stopwords.select(F.col("word").alias("token")).distinct()
    if words.limit(FEW_WORDS + 1).count() <= FEW_WORDS:
        words = F.broadcast(words)
    return rows.join(words, "token", "left_anti").select(*rows.columns)


def counts(tokens: DataFrame) -> DataFrame:
    """(spec_id, token, n)"""
    return tokens.groupBy("spec_id", "token").agg(F.count("*").alias("n"))


def document_frequency(count_rows: DataFrame) -> DataFrame:
    """(token, df) of counts(): each token once a spec, so rows are counted, not distinct specs."""
    return count_rows.groupBy("token").agg(F.count("*").alias("df"))


def vocabulary(frequency: DataFrame, specs: int, idf_max: float | None = IDF_MAX) -> DataFrame:
    """(token, position, df, idf): idf is ln of the whole part of specs / df. Tokens above idf_max go; positions follow the tokens' order."""
    found = frequency.withColumn("idf", F.ln(F.greatest(F.floor(F.lit(specs) / F.col("df")), F.lit(1)).cast("double")))
    if idf_max is not None:
        found = found.where(F.col("idf") <= idf_max)
    return ranked(found, ["token"], F.substring("token", 1, 2), "position").select("token", "position", "df", "idf")


def vectors(count_rows: DataFrame, words: DataFrame, tfidf: bool = True) -> DataFrame:
    """(spec_id, position, x): counts of the vocabulary's tokens; for tfidf divided by their total in the spec, and times idf."""
    found = count_rows.join(words.select("token", "position", "idf"), "token")
    if not tfidf:
        return found.select("spec_id", "position", F.col("n").cast("double").alias("x"))
    # One spec's tokens are one partition: a text's vocabulary, not a group that grows with the corpus.
    total = F.sum("n").over(Window.partitionBy("spec_id"))
    return found.select("spec_id", "position", (F.col("n") / total * F.col("idf")).alias("x"))


def pair_features(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """(spec1, spec2, position, x): the absolute difference of the two specs' vectors, where it isn't 0. Pairs with an unknown spec have the other's numbers."""
    p = pairs.select("spec1", "spec2").distinct()
    left = p.join(vecs.withColumnRenamed("spec_id", "spec1"), "spec1").select("spec1", "spec2", "position", "x")
    right = p.join(vecs.withColumnRenamed("spec_id", "spec2"), "spec2").select("spec1", "spec2", "position", (-F.col("x")).alias("x"))
    return left.union(right).groupBy("spec1", "spec2", "position").agg(F.abs(F.sum("x")).alias("x")).where("x <> 0")
