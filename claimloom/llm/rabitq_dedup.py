"""Embedding near-duplicates with randomised-rotation binary codes.

Each unit vector is rotated by a fixed random orthogonal matrix and keeps the signs
as a code, with its correction factor: the inner product of the code and the rotated
vector. Between a code and another full vector, code product over factor estimates
the cosine without bias. Its upper confidence bound, the lesser of the estimate plus
``sigmas`` standard errors and the certain bound that the angles of the code to both
vectors set, decides whether a pair needs its exact cosine in double precision.

Vectors are compared inside their label only. Equal vectors are one representative
with a count, so copies are never paired. The representatives of a label are dealt in
chunks of ``block_rows`` and every pair of chunks is one bounded task, which returns
link counts and edges that keep its links' connectivity, not the pairs themselves.
The work is quadratic in the distinct vectors of a label.

Defined results: a vector or label that is null, a zero vector and one with null or
non-finite components links with nothing and is its own component. Vectors of unequal
length don't link. A repeated row is one vector and each of its rows is returned.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.plans.components import connected_components
from claimloom.plans.staging import stage


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that no square over- or underflows
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of rows, and the factors."""
    turned = _unit(x.astype(np.float64)) @ rotation(x.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def linked(a: np.ndarray, b: np.ndarray, b_codes: np.ndarray, b_factors: np.ndarray, least: float, sigmas: float, rows: int = 256) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``least``; exact where the bound doesn't settle it."""
    dims = a.shape[1]
    ua, ub = _unit(a), _unit(b)
    turned = (ua @ rotation(dims)).astype(np.float32)
    signs = (np.unpackbits(b_codes, axis=1, count=dims).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dims))
    spread = np.sqrt(np.maximum(1 - b_factors**2, 0)).astype(np.float32)
    factors = b_factors.astype(np.float32)
    slack = np.float32(sigmas) * spread / (factors * np.float32(np.sqrt(max(dims - 1, 1))))
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), rows):
        seen = turned[at : at + rows] @ signs.T
        certain = seen * factors + np.sqrt(np.maximum(1 - seen * seen, 0)) * spread
        near = np.minimum(certain, seen / factors + slack) >= least - 1e-4
        i, j = np.nonzero(near)
        # one way of summing for every pair, some at a time
        for part in range(0, len(i), 1 << 15):
            p, q = at + i[part : part + (1 << 15)], j[part : part + (1 << 15)]
            out[p, q] = np.einsum("ij,ij->i", ua[p], ub[q]) >= least
    return out


def spanning_edges(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a symmetric link matrix: nodes that have links, and each one's root in the matrix."""
    n = len(links)
    root = np.arange(n)
    fresh = links.any(axis=1)
    nodes = np.flatnonzero(fresh)
    for start in nodes:
        if not fresh[start]:
            continue
        fresh[start] = False
        front = np.array([start])
        while len(front):
            hit = links[front].any(axis=0) & fresh
            front = np.flatnonzero(hit)
            fresh[front] = False
            root[front] = start
    return nodes, root[nodes]


def near_duplicates(vectors: DataFrame, least: float = 0.93, sigmas: float = 6.0, block_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("x", lambda v: v != 0))

    @F.pandas_udf("code binary, factor double")
    def coded(xs: pd.Series) -> pd.DataFrame:
        codes, factors = [None] * len(xs), np.zeros(len(xs))
        sizes = xs.map(len).to_numpy()
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            packed, factors[at] = encode(np.stack(xs.iloc[at].tolist()))
            for i, row in zip(at, packed):
                codes[i] = row.tobytes()
        return pd.DataFrame({"code": codes, "factor": factors})

    same = sound.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"))
    reps = stage(same.withColumn("c", coded("x")).select("label", "x", "rep", "copies", "c.code", "c.factor", F.size("x").alias("dims")), "vector-codes").df
    sizes = reps.groupBy("label", "dims").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks"))
    dealt = (
        reps.join(sizes, ["label", "dims"])
        .withColumn("mine", F.pmod(F.xxhash64("rep", "x"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("label", "dims", "rep", "x", "copies", "code", "factor", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a = pdf[pdf["mine"] == lo]
        b = pdf[pdf["mine"] == hi] if hi != lo else a
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "other": [], "n": []})
        xa, xb = np.stack(a["x"].tolist()).astype(np.float64), np.stack(b["x"].tolist()).astype(np.float64)
        codes = np.stack([np.frombuffer(c, np.uint8) for c in b["code"]])
        found = linked(xa, xb, codes, b["factor"].to_numpy(), least, sigmas)
        if hi == lo:
            found |= found.T
            np.fill_diagonal(found, False)
            whole, ids = found, a["rep"].to_numpy()
        else:
            n, m = found.shape
            whole = np.zeros((n + m, n + m), bool)
            whole[:n, n:], whole[n:, :n] = found, found.T
            ids = np.concatenate([a["rep"].to_numpy(), b["rep"].to_numpy()])
        copies = a["copies"].to_numpy() if hi == lo else np.concatenate([a["copies"].to_numpy(), b["copies"].to_numpy()])
        nodes, roots = spanning_edges(whole)
        return pd.DataFrame({"rep": ids[nodes], "other": ids[roots], "n": (whole[nodes] @ copies).astype(np.int64)})

    found = stage(dealt.groupBy("label", "dims", "lo", "hi").applyInPandas(compare, "rep long, other long, n long"), "vector-links").df
    # a representative's id is unique only with its vector when one id holds several vectors; then its links add up
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    components = connected_components(found, "rep", "other")
    heads = (
        reps.select("label", "x", "rep", "copies")
        .join(counts, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "x", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    told = rows.join(heads.withColumnsRenamed({"label": "head_label", "x": "head_x"}), (F.col("label") == F.col("head_label")) & (F.col("x") == F.col("head_x")), "left")
    component = F.coalesce("component_id", "vec_id")
    return told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_rabitq_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings),
ok as (select * from v where label is not null and x is not null and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id
  where list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.93),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least_ as (select a, min(least(a, b)) as c from reach group by 1),
n as (select a, count(*) as n from links group by 1)
select vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, coalesce(least_.c, vec_id) as component_id, coalesce(least_.c, vec_id) = vec_id as kept
from v left join n on n.a = vec_id left join least_ on least_.a = vec_id
"""
