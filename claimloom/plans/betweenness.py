"""Betweenness: how many shortest paths between two others run through a vertex.

Graphs are undirected, given as pairs with the number of parallel edges, which multiply
paths. Every ordered pair of other ends counts, by the share of its shortest paths.

A group (a project) of few pairs is searched by tasks that hold its pairs, its sources
dealt in chunks. A larger group is never held:

* Vertices with one neighbour are folded into it, round by round; each takes the mass of
  what was folded into it along. A folded vertex parts what hangs on it from the rest,
  so masses alone tell its paths, and those that hang on a vertex of the core.
* The core is searched level by level for a block of sources at a time: a level is rows
  (source, vertex, number of shortest paths), the next one joins the pairs and drops the
  two levels before it, and dependencies are summed back from the last level to the
  first. Ends count by their mass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.plans.staging import stage, stage_told

SCORES = "project string, id string, score double"


def betweenness(pairs: DataFrame, small: int = 200_000, folds: int = 8, rows_at_once: int = 50_000_000) -> DataFrame:
    """``(project, id, score)`` of every vertex of ``pairs`` (project, a, b, ways), a pair once, in no order of its ends.

    ``small`` is how many pairs of a project one task may hold. ``folds`` rounds of
    folding come first in larger ones; what they leave stays in the core, where about
    ``rows_at_once`` rows of sources and vertices are searched at a time. A null project
    is left out; no pairs give no rows.
    """
    sizes = pairs.where("project is not null").groupBy("project").agg(F.count("*").alias("n"))
    large, told = stage_told(sizes.where(F.col("n") > small).select("project"), "large-groups", n=F.count("*"))
    if not told["n"]:
        return _in_tasks(pairs.join(sizes.select("project"), "project", "left_semi"))
    held = _in_tasks(pairs.join(sizes.where(F.col("n") <= small).select("project"), "project", "left_semi"))
    return held.unionByName(_in_rounds(stage(pairs.join(large.df, "project", "left_semi"), "large-pairs").df, folds, rows_at_once))


def _in_tasks(pairs: DataFrame, chunk: int = 256) -> DataFrame:
    sources = pairs.select("project", F.explode(F.array("a", "b")).alias("source")).distinct()
    parts = sources.groupBy("project").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    dealt = sources.join(parts, "project").select("project", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("part"), "source")
    beside = pairs.join(parts, "project").select("project", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a", "b", "ways")
    partial = dealt.groupBy("project", "part").cogroup(beside.toDF(*beside.columns).groupBy("project", "part")).applyInPandas(_paths, SCORES)
    return partial.groupBy("project", "id").agg(F.sum("score").alias("score"))


def _paths(some: pd.DataFrame, net: pd.DataFrame) -> pd.DataFrame:
    """What the sources of ``some`` add to the scores of all vertices of ``net``."""
    names, ends = np.unique(np.concatenate([net["a"], net["b"]]), return_inverse=True)
    n = len(names)
    a, b, ways = ends[: len(net)], ends[len(net) :], net["ways"].to_numpy(np.float64)
    tail, head, many = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([ways, ways])
    order = np.argsort(tail, kind="stable")
    head, many = head[order], many[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=n))])
    score = np.zeros(n)

    def out_of(vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all edges out of ``vertices``: whose they are, and where they stand."""
        count = begin[vertices + 1] - begin[vertices]
        whose = np.repeat(np.arange(len(vertices)), count)
        return whose, np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + begin[vertices][whose]

    for source in np.searchsorted(names, some["source"].to_numpy()):
        level, paths = np.full(n, -1), np.zeros(n)
        level[source], paths[source] = 0, 1.0
        levels = [np.array([source])]
        while len(levels[-1]):
            whose, at = out_of(levels[-1])
            to = head[at]
            open_ = level[to] < 0
            np.add.at(paths, to[open_], paths[levels[-1]][whose[open_]] * many[at[open_]])
            new = np.unique(to[open_])
            level[new] = len(levels)
            levels.append(new)
        share = np.zeros(n)
        for depth in range(len(levels) - 2, 0, -1):
            vertices = levels[depth]
            score[vertices] += share[vertices]
            whose, at = out_of(vertices)
            up = level[head[at]] == depth - 1
            w = vertices[whose[up]]
            np.add.at(share, head[at[up]], many[at[up]] * paths[head[at[up]]] / paths[w] * (1 + share[w]))
    return pd.DataFrame({"project": net["project"].iloc[0] if n else "", "id": names, "score": score})


def _either(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair, as ``(project, v, w, ways)``."""
    return pairs.select("project", F.col("a").alias("v"), F.col("b").alias("w"), "ways").unionByName(pairs.select("project", F.col("b").alias("v"), F.col("a").alias("w"), "ways"))


def _hanging(mass: Column, squares: Column, total: Column) -> Column:
    """Ordered pairs that a vertex parts with what hangs on it: of ``mass - 1`` vertices in parts whose squares sum to ``squares``."""
    hung = mass - 1
    return hung * hung - squares + 2 * hung * (total - mass)


def _in_rounds(pairs: DataFrame, folds: int, rows_at_once: int) -> DataFrame:
    vertices = pairs.select("project", F.explode(F.array("a", "b")).alias("id")).distinct()
    core, masses = pairs, stage(vertices.select("project", "id", F.lit(1.0).alias("mass"), F.lit(0.0).alias("squares")), "masses").df
    folded: list[DataFrame] = []
    for _ in range(folds):
        near = _either(core).groupBy("project", F.col("v").alias("id")).agg(F.count("*").alias("n"), F.first("w").alias("into")).where("n = 1")
        # of two that have only each other, the lesser stays
        fold = near.join(near.select("project", F.col("id").alias("into"), F.col("into").alias("back")), ["project", "into"], "left").where("back is null or id > into")
        gone, told = stage_told(fold.select("project", "id", "into").join(masses, ["project", "id"]), "folded", n=F.count("*"))
        if not told["n"]:
            break
        folded.append(gone.df)
        taken = gone.df.groupBy("project", F.col("into").alias("id")).agg(F.sum("mass").alias("more"), F.sum(F.col("mass") * F.col("mass")).alias("more_squares"))
        kept = masses.join(gone.df.select("project", "id"), ["project", "id"], "left_anti").join(taken, ["project", "id"], "left")
        masses = stage(kept.select("project", "id", (F.col("mass") + F.coalesce("more", F.lit(0.0))).alias("mass"), (F.col("squares") + F.coalesce("more_squares", F.lit(0.0))).alias("squares")), "masses").df
        ids = gone.df.select("project", "id")
        core = stage(core.join(ids.withColumnRenamed("id", "a"), ["project", "a"], "left_anti").join(ids.withColumnRenamed("id", "b"), ["project", "b"], "left_anti").select(*pairs.columns), "core").df
    parts = _searched(core, masses, rows_at_once)
    # a vertex of the core without pairs there has all of its component hanging on it
    own = masses.join(parts, ["project", "id"], "left").select(
        "project", "id", F.coalesce("total", "mass").alias("total"), (F.coalesce("inner", F.lit(0.0)) + _hanging(F.col("mass"), F.col("squares"), F.coalesce("total", "mass"))).alias("score")
    )
    out = known = stage(own, "core-scores").df
    for gone in reversed(folded):
        # the size of its component is that of what it was folded into
        rows = gone.join(known.select("project", F.col("id").alias("into"), "total"), ["project", "into"])
        known = stage(known.unionByName(rows.select("project", "id", "total", _hanging(F.col("mass"), F.col("squares"), F.col("total")).alias("score"))), "core-scores").df
        out = known
    return out.select("project", "id", "score")


def _searched(core: DataFrame, masses: DataFrame, rows_at_once: int) -> DataFrame:
    """``(project, id, total, inner)`` of the core's vertices: the mass of their component, and their paths between others of the core."""
    near = stage(_either(core), "core-near").df
    ends, told = stage_told(near.select("project", F.col("v").alias("id")).distinct().join(masses.select("project", "id", "mass"), ["project", "id"]), "core-ends", n=F.count("*"))
    weight = ends.df.select("project", F.col("id").alias("v"), "mass")
    blocks = max(1, -(-told["n"] * told["n"] // rows_at_once))
    totals, inner = [], []
    for block in range(blocks if told["n"] else 0):
        mine = ends.df.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        levels = [stage(mine.select("project", F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level").df]
        while True:
            further = levels[-1].join(near, ["project", "v"]).groupBy("project", "s", F.col("w").alias("v")).agg(F.sum(F.col("paths") * F.col("ways")).alias("paths"))
            for before in levels[-2:]:
                further = further.join(before.select("project", "s", "v"), ["project", "s", "v"], "left_anti")
            level, n = stage_told(further, "level", n=F.count("*"))
            if not n["n"]:
                break
            levels.append(level.df)
        reached = levels[0]
        for level in levels[1:]:
            reached = reached.unionByName(level)
        totals.append(reached.join(weight, ["project", "v"]).groupBy("project", F.col("s").alias("id")).agg(F.sum("mass").alias("total")))
        own_mass = mine.select("project", F.col("id").alias("s"), F.col("mass").alias("of_source"))
        share = None
        for depth in range(len(levels) - 1, 0, -1):
            here = levels[depth].join(weight, ["project", "v"])
            if share is None:
                here = here.withColumn("share", F.lit(0.0))
            else:
                here = here.join(share, ["project", "s", "v"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
                inner.append(share.join(own_mass, ["project", "s"]).groupBy("project", F.col("v").alias("id")).agg(F.sum(F.col("share") * F.col("of_source")).alias("inner")))
            if depth == 1:
                break
            given = here.select("project", "s", "v", ((F.col("mass") + F.col("share")) / F.col("paths")).alias("each")).join(near, ["project", "v"]).select("project", "s", F.col("w").alias("v"), (F.col("each") * F.col("ways")).alias("part"))
            back = given.join(levels[depth - 1], ["project", "s", "v"]).groupBy("project", "s", "v").agg(F.sum(F.col("part") * F.col("paths")).alias("share"))
            share = stage(back, "shares").df
    if not totals:
        return masses.limit(0).select("project", "id", F.lit(0.0).alias("total"), F.lit(0.0).alias("inner"))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    told = union(totals)
    if not inner:
        return told.withColumn("inner", F.lit(0.0))
    return told.join(union(inner).groupBy("project", "id").agg(F.sum("inner").alias("inner")), ["project", "id"], "left")
