"""Packing documents into training sequences by the Harmonic algorithm (operator 1).

Lee and Lee's Harmonic(M): a length in (capacity / (k + 1), capacity / k] is of class k and k of them fill a bin; lengths up to
capacity / M are of class M. A bin needs nothing but the count of its class, so workers (hash buckets of documents) fill
theirs without knowing of each other, and the only shuffle is of (identifier, length) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Shared
from .mixing import SEED, word_count

CAPACITY, CLASSES, WORKER_DOCS = 2048, 64, 1 << 16


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, worker_docs: int = WORKER_DOCS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> DataFrame:
    """(class, worker, bin, slot, doc_id, piece, start_word, n_words): where each piece of each document goes.

    A bin is (class, worker, bin); its slots are 0 .. class - 1, and each worker's last bin of a class may be part full. A document of more than
    capacity words is cut into pieces of capacity words and a rest. Words are set apart by white space. Documents without
    a word (null and empty ones too) have nothing to pack, and rows without an identifier can't be named: they are left out. Repeated identifiers and
    rows are packed each; ties are in the order of identifier, piece and length. Other columns are ignored; an empty table gives no row.
    order: a column of docs by which the bins come, each where the document in its slot 0 stands; what a bin holds doesn't depend on it.
    """
    if not 1 <= classes <= capacity or worker_docs < 1:
        raise ValueError("classes must lie between 1 and capacity, and worker_docs be positive")
    # Numbers of workers in proportion to the documents; a hash keeps them even.
    workers = max(1, -(-docs.count() // worker_docs))
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), word_count(text_col).alias("words"), (F.lit(None) if order is None else order).alias("__order")).where("words > 0")
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long")
    pieces = named.withColumn("worker", (hashed % workers).cast("int")).withColumn("piece", F.explode(F.expr(f"sequence(0L, (words - 1) div {capacity}L)")))
    pieces = pieces.withColumn("start_word", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("start_word")))
    pieces = pieces.withColumn("class", F.least(F.lit(classes), F.expr(f"{capacity}L div n_words")).cast("int"))
    place = F.row_number().over(Window.partitionBy("class", "worker").orderBy("doc_id", "piece", "n_words")) - 1
    packed = pieces.withColumn("__place", place).select("class", "worker", F.expr("__place div class").cast("int").alias("bin"), F.expr("__place % class").cast("int").alias("slot"), "doc_id", "piece", "start_word", "n_words", "__order")
    if order is None:
        return packed.drop("__order")
    bin_ = ["class", "worker", "bin"]
    first = F.min(F.when(F.col("slot") == 0, F.col("__order"))).over(Window.partitionBy(*bin_))
    # Written, as a range partitioning reads its input twice.
    placed = Shared(docs.sparkSession, "packing").written(packed.withColumn("__order", first), "placed")
    return placed.repartitionByRange("__order", *bin_).sortWithinPartitions("__order", *bin_, "slot").drop("__order")


def oracle(documents: str = "documents", capacity: int = CAPACITY, classes: int = CLASSES, worker_docs: int = WORKER_DOCS, seed: int = SEED) -> str:
    return f"""
with pieces as (
  select doc_id, words, piece, piece * {capacity} as start_word, least({capacity}, words - piece * {capacity}) as n_words,
    cast(('0x' || substr(md5('{seed}:' || cast(doc_id as varchar)), 1, 8)) as bigint) % greatest(1, ((select count(*) from {documents}) + {worker_docs - 1}) // {worker_docs}) as worker
  from (select doc_id, words, unnest(range((words - 1) // {capacity} + 1)) as piece
    from (select doc_id, cast(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) as bigint) as words from {documents} where doc_id is not null and text is not null) where words > 0)),
placed as (
  select *, row_number() over (partition by class, worker order by doc_id, piece, n_words) - 1 as place
  from (select *, least({classes}, {capacity} // n_words) as class from pieces))
select cast(class as integer) as class, cast(worker as integer) as worker, cast(place // class as integer) as bin, cast(place % class as integer) as slot, doc_id, piece, start_word, n_words from placed
"""
