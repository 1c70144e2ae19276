"""Connected components by alternating large-star and small-star steps.

Each step is a min aggregation and an equi-join, so a vertex with very many
neighbours is pre-aggregated before the shuffle and its join is open to AQE skew
splitting. Every round is one job: its write to the shared folder cuts the lineage and
takes the totals that tell when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.plans.staging import drop_staged, stage_told


def _star(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with the least ``v`` of each ``u`` beside it, as ``m``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (
        _star(both)
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    joined = _star(large)
    small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        joined.select("u", F.col("m").alias("v"))
    )
    return small.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every vertex that an edge between two vertices touches.

    ``component`` is the least vertex reachable. Edges are undirected; loops,
    repeated edges and edges with a null end are ignored; no edges give no rows.
    Raises if ``max_rounds`` rounds don't settle, rather than return a partial answer.
    """
    told = {"n": F.count("*"), "total": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    first = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    now, seen = stage_told(first, "edges", **told)
    for _ in range(max_rounds):
        after, totals = stage_told(_round(now.df), "edges", **told)
        drop_staged(edges.sparkSession, now.path)
        now = after
        if totals == seen or not totals["n"]:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = totals
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
