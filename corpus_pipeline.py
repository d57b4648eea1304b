"""A corpus pipeline of five stages over the documents table, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import exact, minhash, mixing, packing, toxicity
from kindred.shared import Shared


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the toxic ones, each row judged by its own text. Null and empty texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one text, the one with the smallest identifier. Null texts stay."""
    return exact.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest identifier; of several that share it, the one with the smallest digest of its text.

    Rows are told apart by a key made here: rows that share an identifier are near-duplicates only if their texts are. Rows without an identifier stay.
    """
    work = Shared(spark, "near")
    row, digest = exact.unused(docs.columns, "row", "digest")
    marked = docs.withColumns({row: F.monotonically_increasing_id(), digest: exact.digest("text")})
    keyed = work.written(marked, "rows")
    named = keyed.where(F.col("doc_id").isNotNull())
    copies = minhash.near_duplicates(named.select(F.col(row).alias("doc_id"), "text"))
    groups = work.written(copies.select("doc_id", "keep_id").union(copies.select("keep_id", "keep_id").distinct()).toDF(row, "group"), "groups")
    members = work.written(named.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), F.col(digest).alias("digest")).join(groups.withColumnRenamed(row, "row").hint("merge"), "row"), "members")
    kept = members.groupBy("group").agg(F.min(F.struct("id", "digest", "row")).alias("first")).select("first.row")
    lost = members.select("row").join(kept.hint("merge"), "row", "left_anti").toDF(row)
    return keyed.join(lost.hint("merge"), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of their first slots, all that have an identifier; rows that share one lie together. Rows without one can't be scheduled and go."""
    id_, slot = exact.unused(docs.columns, "id", "slot")
    first = mixing.mixture(docs.select("doc_id", "text", "source")).groupBy(F.col("doc_id").alias(id_)).agg(F.min("slot").alias(slot))
    found = docs.join(first.hint("merge"), F.col("doc_id") == F.col(id_))
    return found.repartitionByRange(F.col(slot), F.col(id_)).sortWithinPartitions(slot, id_).select(*[F.col(f"`{c}`") for c in docs.columns])


def file_order(docs: DataFrame) -> Column:
    """Where each row of docs lies among its files, which were written in order but are read in any; of docs that aren't read from files, among its partitions."""
    try:
        file = docs.metadataColumn("_metadata")
        docs.select(file.getField("row_index"))
    except AnalysisException:
        return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))
    return F.struct(file.getField("file_name").alias("file"), file.getField("row_index").alias("row"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, bins in the order of the documents."""
    return packing.pack_documents(docs, order=file_order(docs))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL expresses neither the toxicity model nor MinHash groups; no test holds run() against brute force. tests/llm compares it with its stages run one by one, and checks mixing and near dedup on small rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Shared(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.written(stage(spark, docs, sf_dir), f"{i}-{name.replace(' ', '-')}")
    return docs
