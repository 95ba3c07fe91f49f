"""Connected components by alternating stars, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.shared import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest node it sees (itself included) to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points its smaller neighbours, and itself, to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node but the roots themselves; root is the smallest node that links reach.

    `links` holds undirected pairs of long columns `a`, `b`; self links and repeats change nothing. Each round is two
    stars (Kiveris et al., 2014), both a min aggregate (combined before the shuffle) joined back on the node, so a hub
    costs as many rows as it has links; O(log n) rounds in practice. Edges are checkpointed every round. No links: no rows.
    """
    edges = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        edges = checkpointed(_small_star(_large_star(edges)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
