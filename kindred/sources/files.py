"""Reading and writing of specs, pairs, stopwords, vocabularies, models and reports."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matcher import Matcher

SPEC_FILE = r"([^/]+)/([^/]+)\.json$"


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """(spec_id, site, num, json) of the files <path>/<site>/<num>.json; spec_id is <site>//<num>."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("value").alias("json"), F.url_decode("_metadata.file_path").alias("file"))
    parts = files.select("json", F.regexp_extract("file", SPEC_FILE, 1).alias("site"), F.regexp_extract("file", SPEC_FILE, 2).alias("num"))
    return parts.select(F.concat_ws("//", "site", "num").alias("spec_id"), "site", "num", "json")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(spec1, spec2, relation) of a CSV file left_spec_id,right_spec_id,label. A spec paired with itself is ignored."""
    rows = spark.read.csv(path, header=True, schema="left_spec_id string, right_spec_id string, label int")
    return rows.where("left_spec_id <> right_spec_id").select(F.col("left_spec_id").alias("spec1"), F.col("right_spec_id").alias("spec2"), F.col("label").alias("relation"))


def read_unlabelled(spark: SparkSession, path: str) -> DataFrame:
    """As read_labelled, of a file without labels; relation is null."""
    rows = spark.read.csv(path, header=True, schema="left_spec_id string, right_spec_id string")
    return rows.select(F.col("left_spec_id").alias("spec1"), F.col("right_spec_id").alias("spec2"), F.lit(None).cast("int").alias("relation"))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word): the distinct words of a file of words between commas."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.split("value", ",")).alias("word")).select(F.trim(F.regexp_replace("word", r"\s+", " ")).alias("word")).where("word <> ''").distinct()


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select(F.col("token").alias("key"), F.col("position").alias("pos"), F.col("df").alias("count"), "idf").write.mode("overwrite").csv(path, header=True)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="token string, position bigint, df bigint, idf double", enforceSchema=True)


def write_model(spark: SparkSession, model, path: str) -> None:
    """One row, in full precision."""
    spark.createDataFrame([(model.mode, model.learning_rate, model.bias, [float(x) for x in model.weights])], "mode string, learning_rate double, bias double, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> Matcher:
    """The model that write_model wrote."""
    row = spark.read.parquet(path).first()
    return Matcher(np.array(row["weights"], float), row["bias"], row["learning_rate"], row["mode"])


def read_model_text(spark: SparkSession, path: str) -> Matcher:
    """The model of a text file with a line each for mode, learning rate, bias, number of weights, and every weight."""
    parts = spark.read.text(path, wholetext=True).first()["value"].split()
    weights = np.array(parts[4:], float)
    if len(parts) < 4 or len(weights) != int(parts[3]):
        raise ValueError(f"{path} doesn't hold the number of weights that it states")
    return Matcher(weights, float(parts[2]), float(parts[1]), parts[0])


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Appends spec1,spec2,relation, each part with its header, as read_pairs takes it."""
    pairs.select("spec1", "spec2", "relation").write.mode("append").csv(path, header=True)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(spec1, spec2, relation) of what write_pairs wrote, in one go or several."""
    return spark.read.csv(path, header=True, schema="spec1 string, spec2 string, relation int")


def write_lines(lines: DataFrame, path: str) -> None:
    """The text of the column `line`."""
    lines.select("line").write.mode("overwrite").text(path)


def printed(value: str) -> str:
    """A JSON text, indented."""
    return json.dumps(json.loads(value), indent=2, ensure_ascii=False)


def printed_column(c: Column) -> Column:
    """JSON texts, indented, a batch at a time (no built-in does it); null for what isn't JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else printed(x)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(c)
