"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

A source's documents, in the order of a seeded hash, are laid end to end on a token axis that is cut
into blocks of `block_tokens`; after the last document the axis starts over, `max_repeat` times at
most. The mix is a row of slots of one block each. Slot i gets the i-th point of a golden-ratio
rotation, the source whose share of the cumulative targets holds the point fills the slot, and the
slot's rank among those of its source says which block it takes. Joining slots with blocks tells how
many words of each document the mix takes.

Nothing is gathered by source: token sums and slot ranks go in two levels (hash buckets and slot
chunks first, then those; there are more of them where there are more rows), and the texts themselves
are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.shared import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: 2**31 divided by the golden ratio, made odd: its multiples visit all residues before they repeat
GOLDEN_31 = 1_327_217_885
CELLS, SLOTS_A_CHUNK, ROWS_A_BUCKET = 1024, 16_384, 4_096


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """source_key, source_size, idx, target and the bounds lo and hi of its share, for each source of sizes (source, source_key, source_size).

    Sources in code point order, null last, take the weights in turn. A target stops at max_repeat
    times its source's size. Sorted by size against weight, the sources that stop come first, and what
    they leave is shared at one rate, the greatest that occurs.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.withColumn("idx", F.row_number().over(order))
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("idx") - 1) % len(weights) + 1).cast("int")).cast("double"))
    src = src.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    src = src.withColumn("r", left / heavy)
    src = src.withColumn("target", F.least("cap", F.col("weight") * F.max("r").over(everything)))
    up_to = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    src = src.withColumn("hi", F.sum("target").over(up_to)).withColumn("lo", F.col("hi") - F.col("target"))
    whole = F.nullif(F.max("hi").over(everything), F.lit(0.0))
    return src.select("source_key", "source_size", "idx", "target", (F.col("lo") / whole).alias("lo"), (F.col("hi") / whole).alias("hi"))


def _slots(src: DataFrame, n_slots: int) -> DataFrame:
    """slot, idx and block (rank of the slot among those of its source) of each slot."""
    cells = src.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))))).select("idx", "lo", "hi", "cell")
    slots = src.sparkSession.range(n_slots).select(F.col("id").alias("slot"), (((F.col("id") % 2**31) * GOLDEN_31) % 2**31 / float(2**31)).alias("point"))
    slots = slots.withColumn("at", F.floor(F.col("point") * CELLS))
    slots = slots.join(cells, (F.col("at") == F.col("cell")) & (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    slots = slots.select("slot", "idx", F.floor(F.col("slot") / SLOTS_A_CHUNK).alias("chunk"))
    in_chunk = slots.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "idx").orderBy("slot")) - 1)
    earlier = Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = slots.groupBy("chunk", "idx").count().withColumn("r0", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    return in_chunk.join(chunks, ["chunk", "idx"]).select("slot", "idx", (F.col("r") + F.col("r0")).alias("block"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, block_tokens: int = 128, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot and last_slot for each row of docs (doc_id, text, source).

    size counts the words of the text (0 for null or blank ones, which the mix takes nothing of). The mix is
    its slots in order; first_slot and last_slot say between which of them the document's words stand (null
    where none is taken). A repeated row is a document of its own; rows with a null source form one source;
    rows with a null doc_id are told apart by their texts. Equal rows may trade places. Targets and takings
    of a table without words are 0. Columns other than these are not read.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))))
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")).alias("shuffled"),
    )
    sized = cut_lineage(sized)
    # the order is that of the hash whatever the number of buckets, which are its first digits
    digits = max(1, math.ceil(math.log(max(1, sized.count() / ROWS_A_BUCKET), 16)))
    sized = sized.withColumn("bucket", F.conv(F.substring("shuffled", 1, digits), 16, 10).cast("long"))

    buckets = cut_lineage(sized.groupBy("source", "source_key", "bucket").agg(F.sum("size").alias("words")))
    src = source_targets(buckets.groupBy("source", "source_key").agg(F.sum("words").alias("source_size")), weights, max_repeat)
    total = buckets.agg(F.sum("words")).first()[0] or 0
    slots = cut_lineage(_slots(src, -(-total // block_tokens)))
    filled = slots.groupBy("idx").count().withColumnRenamed("count", "blocks")
    src = src.join(filled, "idx", "left").select("source_key", "source_size", "idx", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"))

    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source_key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")).join(src, "source_key")
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy("shuffled", "doc_id", "size")
    laid = sized.withColumn("n", F.row_number().over(in_bucket)).withColumn("upto", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(offsets, ["source_key", "bucket"]).withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))

    passes = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(max_repeat - 1)))
    copies = laid.select("idx", "bucket", "n", "doc_id", "source", "size", "source_size", "target", "blocks", "start", F.explode_outer(passes).alias("pass"))
    begin = F.col("start") + F.col("pass") * F.col("source_size")
    copies = copies.withColumn("begin", begin).withColumn("end", begin + F.col("size"))
    first, last = F.floor(F.col("begin") / block_tokens), F.least(F.floor((F.col("end") - 1) / block_tokens), F.col("blocks") - 1)
    copies = copies.withColumn("block", F.explode_outer(F.when(first <= last, F.sequence(first, last))))
    taken = slots.select("slot", F.col("idx").alias("s_idx"), F.col("block").alias("s_block"))
    pieces = copies.join(taken, (F.col("idx") == F.col("s_idx")) & (F.col("block") == F.col("s_block")), "left")
    overlap = F.least("end", (F.col("block") + 1) * block_tokens) - F.greatest("begin", F.col("block") * block_tokens)
    return pieces.groupBy("idx", "bucket", "n", "doc_id", "source", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.when(F.col("s_block").isNotNull(), overlap)), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    ).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "last_slot")
