"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import cut_lineage

#: Edges of a node that one task takes together.
HOT = 2_000


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step over pairs (u, v): every v of a node u is tied to the smallest node among u and its vs.

    A node with more than HOT pairs is dealt out by a hash of v. There are fewer such nodes than pairs / HOT; they are
    broadcast within the step's own plan, so a step is one action.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("count"))
    parts = F.ceil(F.col("count") / HOT)
    hot = least.filter(F.col("count") > HOT).select(F.col("u").alias("_u"), parts.alias("_parts"))
    dealt = pairs.join(F.broadcast(hot), F.col("u") == F.col("_u"), "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("_parts", F.lit(1))).alias("_part"))
    repeated = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    tied = dealt.join(repeated, ["u", "_part"])
    if large:
        return tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(tied.select("u", "m")).filter("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a, b), a > b, are stars: every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for each node of edges (a, b).

    Loops and repeated edges are harmless; an edge with a null end is left out; no edges, no rows. Each
    step is written to the shared checkpoint folder, so its lineage does not grow and a lost executor
    costs one step. The minimum of a node is aggregated before the shuffle and joined back with the edges
    of a node with very many of them dealt out, so they are not gathered in one task. A round is three
    actions; edges that are stars already, as labels of an earlier call, take none.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = cut_lineage(_star(both, True).distinct())
        edges = cut_lineage(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
