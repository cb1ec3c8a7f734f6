"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import drop_written, joined_on, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood; n is the number of edges."""
    both = edges.union(edges.select("v", "u"))
    least = written(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("n")), "least")
    return joined_on(both.where("v > u"), least, "u", 2 * n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    kept = joined_on(down, least, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of the edges (columns u, v of one orderable type).

    Loops and repeated edges are fine, edges with a null end are ignored, and an empty table has no
    nodes. Each round is written to the shared folder, which cuts the lineage; the number of rounds
    grows with the logarithm of the largest component. Hubs are aggregated before the shuffle and
    joined by broadcast.
    """
    edges = written(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        # a large star has no more edges than there were
        large = written(_large_star(edges, before[0]), "large")
        after = written(_small_star(large, before[0]), "edges")
        drop_written(large)
        now = _state(after)
        drop_written(edges)
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
