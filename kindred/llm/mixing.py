"""Mixing sources to target weights by a low-discrepancy schedule (operator 7).

Point p of the schedule is (p * 2654435769 mod 2**32) / 2**32, a golden-ratio sequence, mapped through the sources' cumulative
weights: over any stretch of points each source gets its share to within a few. A source's points are ranked, and its
r-th takes its r-th block of `block_tokens` tokens: its documents lie on end in a seeded random order, and a document that crosses
the end of a block is cut there, so all blocks but a source's last are equal. Points of a source that has run out
are passed over, which leaves its share to the others in proportion to their weights. Slots number the points that took a block.
Blocks that POINTS points a block haven't reached (those of sources with next to no weight) follow, by how far each source has come in proportion to its weight.

All arithmetic is on integers. Ranks and running totals are two-level: totals by bucket first, then sums within buckets, so
no source, however hot, is one task's; the number of buckets follows the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Shared

BLOCK_TOKENS, SEED, BUCKET_ROWS, SLOT_BUCKET, CELLS, POINTS = 8192, 42, 1 << 14, 1 << 16, 1 << 12, 8
GOLDEN, ONE, SLOT_MASK = 2654435769, 1 << 32, (1 << 31) - 1
NO_SOURCE = "(none)"
WORD = r"[^ \t\n\r]+"


def word_count(text: str) -> Column:
    """Words set apart by blanks, tabs and line ends; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value over the rows before, of equal keys and in the order of (bucket, order)."""
    rows = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, bucket, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    return df.join(totals, [*keys, bucket]).withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(rows), F.lit(0))).drop("__before")


def schedule(spark, weights: DataFrame, slots: int) -> DataFrame:
    """(slot, source, rank) of slots 0 .. slots - 1. weights: source, weight (positive integers below 2**31 in all), low (the sum before)."""
    total = weights.agg(F.sum("weight")).first()[0] or 1
    cell = lambda c: F.expr(f"({c}) * {CELLS}L div {total}L")
    point = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"(((id & {SLOT_MASK}L) * {GOLDEN}L) & {ONE - 1}L) * {total}L div {ONE}L").alias("point"))
    spread = weights.select("source", "low", (F.col("low") + F.col("weight")).alias("high")).withColumn("cell", F.explode(F.sequence(cell("low"), cell("high - 1"))))
    placed = point.withColumn("cell", cell("point")).join(spread, "cell").where("point >= low and point < high")
    return running(placed.select("slot", "source", F.expr(f"slot div {SLOT_BUCKET}").alias("__bucket")), ["source"], "__bucket", ["slot"], F.lit(1).cast("long"), "rank").drop("__bucket")


def remainder(spark, work: Shared, placed: DataFrame, by_source: DataFrame, slots: int, total: int) -> DataFrame:
    """(slot, source, block) of the blocks that placed doesn't have, from slot `slots` on.

    The d-th block left of a source comes at (d + 1/2) * total / weight, counted in half slots.
    """
    taken = placed.groupBy("source").agg(F.count("*").alias("taken"))
    taken = by_source.select("source", "weight", "blocks").join(taken, "source", "left").select("source", "weight", "blocks", F.coalesce("taken", F.lit(0)).alias("taken"))
    each = taken.where("taken < blocks").select("source", "weight", "taken", F.explode(F.sequence("taken", F.col("blocks") - 1)).alias("block"))
    each = each.select("source", "block", F.expr(f"(2 * (block - taken) + 1) * {total}L div weight").alias("__at")).withColumn("__bucket", F.expr(f"__at div {2 * SLOT_BUCKET}"))
    each = running(work.written(each, "left"), [], "__bucket", ["__at", "source", "block"], F.lit(1).cast("long"), "__n")
    return each.select((F.col("__n") + slots).alias("slot"), "source", "block")


def mixture(docs: DataFrame, weights: dict[str, int] | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(slot, source, block, doc_id, start_word, n_words): the pieces of all documents of the weighted sources, by slot.

    weights: source to a positive integer, below 2**31 in all; others get nothing. Without weights, a source weighs the whole
    part of the square root of its tokens, so that large ones are damped. Tokens are words set apart by white space.
    Every token has one slot. A very long document fills blocks of its own. A null source is the source "(none)". Documents without a word
    (null and empty texts too) are a piece of no words in the block of the word before them. Rows without an identifier are left out; rows that share one, and repeated rows, all count. Ties
    in the random order are settled by identifier and length. Other columns are ignored, whatever their names; an empty table gives no row.
    """
    spark = docs.sparkSession
    work = Shared(spark, "mixing")
    identifier, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    named = docs.where(identifier.isNotNull()).select(identifier.cast("long").alias("doc_id"), F.coalesce(source.cast("string"), F.lit(NO_SOURCE)).alias("source"), word_count(f"`{text_col}`").alias("n_words"))
    if weights is not None:
        if any(w < 1 for w in weights.values()) or sum(weights.values()) >= 1 << 31:
            raise ValueError("weights must be positive and sum to less than 2**31")
        named = named.where(F.col("source").isin(list(weights)))
    named = work.written(named.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))), "counts")
    digits, n = 1, named.count()
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    named = named.withColumn("__bucket", F.substring("__h", 1, digits))
    placed = running(named, ["source"], "__bucket", ["__h", "doc_id", "n_words"], F.col("n_words"), "__first")
    b = block_tokens
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(greatest(__first - if(n_words = 0, 1, 0), 0L) div {b}L, greatest(__first + n_words - 1, 0L) div {b}L)")))
    start = F.expr(f"greatest(block * {b}L - __first, 0L)")
    pieces = cut.select("doc_id", "source", "block", start.alias("start_word"), (F.least(F.col("n_words"), F.expr(f"(block + 1) * {b}L - __first")) - start).alias("n_words"))
    pieces = work.written(pieces, "pieces")
    work.dropped("counts")
    by_source = pieces.groupBy("source").agg((F.max("block") + 1).alias("blocks"), F.sum("n_words").alias("tokens"))
    if weights is None:
        by_source = by_source.withColumn("weight", F.greatest(F.floor(F.sqrt(F.col("tokens").cast("double"))), F.lit(1)).cast("long"))
    else:
        by_source = by_source.withColumn("weight", F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")).cast("long"))
    # One row a source.
    by_source = work.written(by_source.withColumn("low", F.coalesce(F.sum("weight").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "sources")
    total, blocks = by_source.agg(F.sum("weight"), F.sum("blocks")).first()
    points = min(POINTS * blocks, by_source.agg(F.max(F.expr(f"blocks * {total}L div weight"))).first()[0] + 1) if total else 0
    kept = schedule(spark, by_source, points).join(by_source.select("source", "blocks"), "source").where("rank < blocks")
    kept = kept.select("source", F.col("rank").alias("block"), F.col("slot").alias("__p"), F.expr(f"slot div {SLOT_BUCKET}").alias("__bucket"))
    kept = work.written(running(kept, [], "__bucket", ["__p"], F.lit(1).cast("long"), "slot").select("slot", "source", "block"), "placed")
    every = kept.union(remainder(spark, work, kept, by_source, kept.count(), total or 1))
    return every.join(pieces, ["source", "block"]).select("slot", "source", "block", "doc_id", "start_word", "n_words")


ORACLE = f"""
with named as (
  select doc_id, coalesce(source, '{NO_SOURCE}') as source, cast(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) as bigint) as n_words, md5('{SEED}:' || cast(doc_id as varchar)) as h
  from documents where doc_id is not null),
placed_docs as (
  select doc_id, source, n_words, cast(coalesce(sum(n_words) over (partition by source order by h, doc_id, n_words rows between unbounded preceding and 1 preceding), 0) as bigint) as first_word from named),
cut as (
  select *, unnest(range(greatest(first_word - case when n_words = 0 then 1 else 0 end, 0) // {BLOCK_TOKENS}, greatest(first_word + n_words - 1, 0) // {BLOCK_TOKENS} + 1)) as block from placed_docs),
pieces as (
  select doc_id, source, block, greatest(block * {BLOCK_TOKENS} - first_word, 0) as start_word,
    least(n_words, (block + 1) * {BLOCK_TOKENS} - first_word) - greatest(block * {BLOCK_TOKENS} - first_word, 0) as n_words from cut),
weighed as (
  select source, max(block) + 1 as blocks, greatest(cast(floor(sqrt(cast(sum(n_words) as double))) as bigint), 1) as weight from pieces group by source),
sources as (
  select source, blocks, weight, cast(coalesce(sum(weight) over (order by source rows between unbounded preceding and 1 preceding), 0) as bigint) as low, cast(sum(weight) over () as bigint) as total from weighed),
points as (
  select p, ((p & {SLOT_MASK}) * {GOLDEN}) & {ONE - 1} as u from range((select least({POINTS} * cast(sum(blocks) as bigint), max(blocks * total // weight) + 1) from sources)) r(p)),
ranked as (
  select p, source, blocks, row_number() over (partition by source order by p) - 1 as block
  from points join sources on u * total // {ONE} >= low and u * total // {ONE} < low + weight),
kept as (select row_number() over (order by p) - 1 as slot, source, block from ranked where block < blocks),
taken as (select s.source, weight, total, blocks, (select count(*) from kept k where k.source = s.source) as taken from sources s),
others as (select source, block, (2 * (block - taken) + 1) * total // weight as due from (select *, unnest(range(taken, blocks)) as block from taken)),
slots as (
  select slot, source, block from kept
  union all select (select count(*) from kept) + row_number() over (order by due, source, block) - 1, source, block from others)
select slot, slots.source, slots.block, doc_id, start_word, n_words from slots join pieces on slots.source = pieces.source and slots.block = pieces.block
"""
