"""Mixing sources to target weights with a low-discrepancy slot schedule.

DataFrame functions only.  The corpus is seen as one token line per source: its
documents in a seeded shuffle, cut into blocks of equal length.  A golden-ratio
sequence, mapped through the cumulative slot quotas, says which source fills
each slot of the mix; the r-th slot of a source takes that source's block
``r mod blocks``.  What a document contributes is the sum of its overlap with
the blocks taken, and its place in the mix is the slot of its first block.

The points are multiples of g modulo N, for N slots and g the integer without common
factor with N at N over the golden ratio or next above it: a golden-ratio sequence that meets
each of N places once, so that a source gets its quota of slots exactly.

Null text has size 0, a null source is a source of its own (last in order), and
repeated rows are separate documents.  An empty table gives an empty result;
a source without words gets target 0.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written

#: Words of the size measure, and 2^32 over the golden ratio.
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN, CYCLE = 2654435769, 4294967296

#: Most slots of a mix (N squared is a long); blocks get longer where there would be more.
MOST_SLOTS = 1 << 31
CELLS = 1024
CHUNK_SLOTS = 65536
BUCKET_ROWS = 2048


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """One small row per document: id, source key, size and shuffle key; written once."""
    got = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("_source"),
        word_count(F.col(text_col)).alias("size"),
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("null"))
    rnd = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("_id").cast("string"), F.col("size").cast("string")))
    return written(got.withColumns({"_key": key, "_rnd": rnd}), "mix-sized")


def source_targets(
    sized: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    max_repeat: float = 2.0,
    block_words: int = 4096,
    min_blocks: int = 256,
) -> DataFrame:
    """Targets per source, filled up to caps, with block length and slot quota.

    Sources take ``weights`` in turn, in code point order, null last.  A source is
    capped at ``max_repeat`` times its size; its excess goes to the others by
    weight.  In order of cap over weight, the level that the rest would get rises as
    long as the next source is below it and falls after that, so the fill level is
    the largest: sources below it are capped, the others get level times weight.  The windows run over one
    row per source, not over documents.
    """
    table = sized.groupBy("_key", "_source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = table.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    ratio = (F.col("cap") / F.col("weight")).alias("ratio")
    table = table.withColumn("ratio", ratio)
    before = Window.orderBy("ratio", "_key").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    table = table.withColumn("_level", (total - spent) / open_weight)
    table = table.withColumn("_level", F.max("_level").over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))
    size = F.col("source_size")
    table = table.withColumn("target", target)
    words = F.greatest(F.lit(block_words), F.ceil(total / F.lit(MOST_SLOTS // 2)))
    blocks = F.greatest(F.ceil(size / words), F.least(size, F.lit(min_blocks)), F.lit(1))
    table = table.withColumn("block_len", F.greatest(F.ceil(size / blocks), F.lit(1)).cast("long"))
    table = table.withColumn("blocks", F.ceil(size / F.col("block_len")).cast("long"))
    passes = F.floor(F.col("target") / F.greatest(size, F.lit(1))).cast("long")
    rest = F.round((F.col("target") - passes * size) / F.col("block_len")).cast("long")
    limit = (F.floor(F.lit(float(max_repeat))) * F.col("blocks")).cast("long")
    quota = F.when(size > 0, F.least(passes * F.col("blocks") + rest, limit)).otherwise(F.lit(0)).cast("long")
    table = table.withColumn("quota", quota)
    up_to = Window.orderBy(F.col("_source").asc_nulls_last())
    table = table.withColumn("hi", F.sum("quota").over(up_to)).withColumn("lo", F.col("hi") - F.col("quota"))
    return written(table.select("_key", "_source", "source_size", "weight", "target", "block_len", "blocks", "quota", "lo", "hi"), "mix-sources")


def golden_multiplier(slots: int) -> int:
    """The first integer from slots over the golden ratio on that has no common factor with ``slots``."""
    g = max(1, slots * GOLDEN // CYCLE)
    while gcd(g, slots) > 1:
        g += 1
    return g


def slot_schedule(targets: DataFrame) -> DataFrame:
    """(slot, _key, rank, pass, block): the mix's slots in order.

    The point of each slot is looked up among the cumulative quotas by an equality
    join on a grid cell.  Ranks are counted per chunk of slots and offset by the counts
    of earlier chunks, so no source's slots meet in one task.
    """
    spark = targets.sparkSession
    total = targets.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    n = F.lit(max(total, 1))
    slots = spark.range(total).select(F.col("id").alias("slot"), (F.col("id") * F.lit(golden_multiplier(max(total, 1))) % n).alias("u"))
    cell = lambda place: F.floor(place * CELLS / n).cast("int")
    cells = targets.filter("quota > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    cells = cells.select("cell", "_key", "blocks", "lo", "hi")
    placed = slots.withColumn("cell", cell(F.col("u"))).join(cells, "cell").filter("u >= lo AND u < hi").select("slot", "_key", "blocks", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    counts = placed.groupBy("_key", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_key", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("_key", "chunk").orderBy("slot")
    ranked = placed.withColumn("_rn", F.row_number().over(within)).join(counts, ["_key", "chunk"]).withColumn("rank", F.col("before") + F.col("_rn") - 1)
    return ranked.select("slot", "_key", "rank", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), F.pmod("rank", "blocks").alias("block"))


def placed_documents(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with their offset on their source's shuffled token line.

    Offsets are sums over hash buckets plus sums within a bucket, so a source with
    a third of all rows is spread over many tasks.
    """
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    rows = sized.withColumn("_bucket", F.floor(F.conv(F.substring("_rnd", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) * buckets).cast("long"))
    sums = rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_key", "_bucket").orderBy("_rnd", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["_key", "_bucket"])
    rows = rows.withColumn("offset", F.col("_base") + F.col("_in"))
    return rows.select("_id", "_key", "size", "offset").join(targets.select("_key", "source_size", "target", "block_len", "blocks", "quota"), "_key")


def _block_spans(placed: DataFrame) -> DataFrame:
    """``placed`` documents with words, a row per block of their source that they have words in."""
    first, end = F.col("offset"), F.col("offset") + F.col("size")
    spans = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(first / F.col("block_len")), F.floor((end - 1) / F.col("block_len")))))
    words = F.least(end, (F.col("block") + 1) * F.col("block_len")) - F.greatest(first, F.col("block") * F.col("block_len"))
    return spans.withColumn("_words", words.cast("long"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20_240_601, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_repeat: float = 2.0, block_words: int = 4096, min_blocks: int = 256) -> DataFrame:
    """Per document: size, its source's size and target, the words the mix takes, and the slot of the first of them (null if none)."""
    sized = sized_documents(docs, id_col, text_col, source_col, seed)
    targets = source_targets(sized, weights, budget, max_repeat, block_words, min_blocks)
    placed = placed_documents(sized, targets)
    times = slot_schedule(targets).groupBy("_key", "block").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    spans = _block_spans(placed).join(times, ["_key", "block"], "left")
    total = F.sum(F.col("_words") * F.coalesce("times", F.lit(0))).cast("long")
    taken = spans.groupBy("_id", "_key", "offset", "size", "source_size", "target").agg(total.alias("taken"), F.min("slot").alias("first_slot"))
    empty = placed.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")})
    cols = [F.col("_id").alias(id_col), "size", "source_size", "target", "taken", "first_slot"]
    return taken.select(*cols).unionByName(empty.select(*cols))


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20_240_601, **options) -> DataFrame:
    """The mix itself, in the order of its slots: ``docs`` rows, once per pass that takes words of them.

    A row stands at the slot of its first block.  A source's ranks go through its blocks
    in order, so a pass holds a prefix of each document: the whole text, or the words up
    to a cut.  Texts cut short have their words joined by single spaces.  Column names
    that start with ``__tessera`` are reserved.
    """
    sized = sized_documents(docs, id_col, text_col, source_col, seed)
    targets = source_targets(sized, **options)
    slots = slot_schedule(targets).select("_key", "block", F.col("pass").alias("__tessera_pass"), "slot")
    spans = _block_spans(placed_documents(sized, targets)).join(slots, ["_key", "block"])
    passes = spans.groupBy(F.col("_id").alias("__tessera_id"), F.col("size").alias("__tessera_size"), "_key", "offset", "__tessera_pass").agg(F.sum("_words").alias("__tessera_kept"), F.min("slot").alias("__tessera_slot"))
    same = ["__tessera_id", "__tessera_size", "__tessera_pass"]  # rows that repeat an id and a size are taken as one of them is
    passes = passes.groupBy(*same).agg(F.max("__tessera_kept").alias("__tessera_kept"), F.min("__tessera_slot").alias("__tessera_slot"))
    texts = docs.withColumn("__tessera_words", word_count(F.col(text_col)))
    rows = texts.join(passes, texts[id_col].eqNullSafe(passes["__tessera_id"]) & (texts["__tessera_words"] == passes["__tessera_size"])).drop("__tessera_id", "__tessera_size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__tessera_kept").cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(F.col("__tessera_kept") == F.col("__tessera_words"), F.col(text_col)).otherwise(cut))
    ordered = written(rows, "mixed").repartitionByRange("__tessera_slot", id_col).sortWithinPartitions("__tessera_slot", id_col)
    return ordered.drop("__tessera_slot", "__tessera_pass", "__tessera_kept", "__tessera_words")
