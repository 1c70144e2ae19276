"""Strongly connected components by colouring.

Vertices that no cycle can hold, those without a way in or out, are trimmed round by
round. Then each vertex takes the least vertex that reaches it for its colour; within a
colour, what reaches that least vertex is its component, and the rest goes on. All
rounds are joins and aggregations over the open part of the graph; several are one job,
whose write cuts the lineage and tells whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.plans.staging import Staged, stage, stage_told


def _trimmed(steps: DataFrame) -> DataFrame:
    """Edges whose tail has a way in and whose head has a way out."""
    tails, heads = steps.select(F.col("u").alias("x")).distinct(), steps.select(F.col("v").alias("x")).distinct()
    return steps.join(heads.withColumnRenamed("x", "u"), "u", "left_semi").join(tails.withColumnRenamed("x", "v"), "v", "left_semi").select("u", "v")


def _settle(first: DataFrame, step, at_once: int, max_rounds: int, **told) -> Staged:
    """``step`` repeated until its totals no longer change."""
    now, seen = stage_told(first, "strong", **told)
    for _ in range(0, max_rounds, at_once):
        after = now.df
        for _ in range(at_once):
            after = step(after)
        now, totals = stage_told(after, "strong", **told)
        if totals == seen:
            return now
        seen = totals
    raise RuntimeError(f"strong components did not settle in {max_rounds} rounds; raise max_rounds")


def strongly_connected(edges: DataFrame, src: str = "src", dst: str = "dst", at_once: int = 4, max_rounds: int = 10_000) -> DataFrame:
    """``(node, component)`` of the vertices that lie on a cycle of two vertices or more; ``component`` is its least vertex.

    Loops, repeated edges and edges with a null end are ignored; no cycles give no rows.
    Raises if ``max_rounds`` rounds don't settle, rather than return a partial answer.
    """
    spark = edges.sparkSession
    steps = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    kind = steps.schema["u"].dataType
    found = []
    for _ in range(max_rounds):
        open_ = _settle(steps, _trimmed, at_once, max_rounds, n=F.count("*")).df
        if open_.isEmpty():
            break

        def coloured(colours: DataFrame, open_: DataFrame = open_) -> DataFrame:
            said = open_.join(colours.select(F.col("x").alias("u"), "c"), "u").select(F.col("v").alias("x"), "c")
            return colours.unionByName(said).groupBy("x").agg(F.min("c").alias("c"))

        vertices = open_.select(F.explode(F.array("u", "v")).alias("x")).distinct()
        changes = {"n": F.count("*"), "total": F.sum(F.xxhash64("x", "c").cast("decimal(38,0)"))}
        colours = _settle(vertices.select("x", F.col("x").alias("c")), coloured, at_once, max_rounds, **changes).df
        # ways within a colour, to be followed backwards from its least vertex
        inner = open_.join(colours.select(F.col("x").alias("u"), "c"), "u").join(colours.select(F.col("x").alias("v"), F.col("c").alias("d")), "v").where("c = d").select("u", "v", "c")
        inner = stage(inner, "strong-inner").df

        def reached(marked: DataFrame, inner: DataFrame = inner) -> DataFrame:
            back = inner.join(marked.select(F.col("x").alias("v")), "v").select(F.col("u").alias("x"), "c")
            return marked.unionByName(back).distinct()

        marked = _settle(colours.where("x = c"), reached, at_once, max_rounds, n=F.count("*")).df
        found.append(marked)
        left = open_.join(marked.select(F.col("x").alias("u")), "u", "left_anti").join(marked.select(F.col("x").alias("v")), "v", "left_anti")
        steps = stage(left.select("u", "v"), "strong-left").df
    else:
        raise RuntimeError(f"strong components did not settle in {max_rounds} rounds; raise max_rounds")
    if not found:
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    sizes = out.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
    return out.join(sizes.select("c"), "c", "left_semi").select(F.col("x").alias("node"), F.col("c").alias("component"))
