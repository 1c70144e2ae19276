"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

The labelled side is a sample of at most ``max_labelled`` rows in the order of a hash
of their ids; that bound makes both the fit on the driver and what is broadcast
(``max_labelled`` vectors of ``rank`` numbers) independent of the input. Texts become
hashed byte trigrams with style counts beside them (repeated words, capitals, signs),
log-weighted by inverse document frequency, and are projected by the sample's
truncated singular vectors. Every document takes exact cosines with every labelled
vector, a block of rows at a time; its ``neighbours`` nearest vote with weight
``max(cosine, 0) ** power``, classes weighted to balance.

Defined results: null and empty texts and those shorter than a trigram have a zero
vector where no style count is set and then take the share of label 1 as their score;
with no labelled rows every score is 1 (nothing is known against any text). Whole
texts are read. Repeated rows get the same score each. A label that is null, or of a
row without a document, is not used. The input columns beyond id and text are not used.
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.features import free_name, gram_counts, packed_counts, unpacked_counts

BITS = 10
STYLE = 12


class Fitted(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    base: float
    neighbours: int
    power: float


def style_counts(data: bytes) -> np.ndarray:
    """Shares of a text's words and bytes that mark its style, in steps so that they act as repeated terms."""
    out = np.zeros(STYLE, np.float32)
    words = data.split()
    n = len(words)
    if n == 0:
        return out
    b = _KIND[np.frombuffer(data, np.uint8)]
    out[0] = sum(map(eq, words, words[1:])) / n
    out[1] = 1 - len(set(words)) / n
    out[2:8] = np.bincount(b, minlength=6) / len(b)
    out[8] = np.count_nonzero((b[:-1] == 4) & (b[1:] == 0)) / n
    out[9] = np.count_nonzero((b[:-1] == 2) & (b[1:] == 2)) / len(b)
    out[10] = min(1.0, 20 * (data.count(b"\n") + 1) / n)
    out[11] = np.count_nonzero((b[:-2] == 0) & (b[1:-1] == 4) & (b[2:] == 0)) / n
    return np.rint(100 * out).astype(np.float32)


_KIND = np.full(256, 5, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4


def counts_of(text: str | None) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return np.concatenate([gram_counts(data, BITS), style_counts(data)])


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Trigrams and style each at unit length, so that neither drowns the other."""
    x = np.log1p(counts, dtype=np.float32)
    x *= idf
    for part in (slice(0, 1 << BITS), slice(1 << BITS, None)):
        length = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] /= np.where(length > 0, length, 1)
    return x


def fit(counts: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, power: float) -> Fitted:
    """The model of a sample's trigram and style counts."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    blocks = [slice(at, at + 512) for at in range(0, len(counts), 512)]
    # the sample's second moments, a block of rows at a time
    moments = np.zeros((counts.shape[1],) * 2, np.float32)
    for rows in blocks:
        x = _scaled(counts[rows], idf)
        moments += x.T @ x
    axes = np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1][:, :rank]).astype(np.float32)
    z = np.concatenate([_scaled(counts[rows], idf) @ axes for rows in blocks])
    length = np.linalg.norm(z, axis=1, keepdims=True)
    return Fitted(idf, axes, z / np.where(length > 0, length, 1), labels.astype(np.float32), float(labels.mean()), neighbours, power)


def vote(model: Fitted, counts: np.ndarray) -> np.ndarray:
    """Scores of a block of rows: the share of the neighbours' weight that label 1 holds."""
    z = _scaled(counts, model.idf) @ model.axes
    length = np.linalg.norm(z, axis=1, keepdims=True)
    cosines = (z / np.where(length > 0, length, 1)) @ model.vectors.T
    k = min(model.neighbours, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weights = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** model.power
    good = weights * model.good[near] * (0.5 / max(model.base, 1e-6) if model.base < 1 else 1)
    bad = weights * (1 - model.good[near]) * (0.5 / max(1 - model.base, 1e-6) if model.base > 0 else 1)
    total = good.sum(axis=1) + bad.sum(axis=1)
    known = (length[:, 0] > 0) & (total > 0)
    return np.where(known, good.sum(axis=1) / np.where(known, total, 1), model.base)


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def fit_from(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, max_labelled: int = 4000, rank: int = 48, neighbours: int = 25, power: float = 8.0) -> Fitted | None:
    """The model of at most ``max_labelled`` labelled ids outside the held-out fold, one text (the least) of each; None if there are none."""
    known = labels.where("quality is not null and doc_id is not null").where(fold("doc_id", folds) != held_out).select("doc_id", "quality").distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([packed_counts(counts_of(t)) for t in texts])

    # one text an id, so that the rows fetched are at most max_labelled however often an id is repeated
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", packed("text").alias("x")).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("x", "ascending")])
    if not rows.num_rows:
        return None
    counts = unpacked_counts(rows.column("x").to_pylist(), (1 << BITS) + STYLE)
    return fit(counts, rows.column("quality").to_numpy(), rank, neighbours, power)


def score(docs: DataFrame, model: Fitted | None) -> Column:
    """The quality score of column ``text``."""
    if model is None:
        return F.lit(1.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 512):
            out.append(vote(shared.value, np.stack([counts_of(t) for t in texts.iloc[at : at + 512]])))
        return pd.Series(np.concatenate(out).astype(np.float64) if out else [], dtype="float64")

    return of(F.col("text"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    name = free_name(docs, "quality_score")
    return docs.withColumn(name, score(docs, fit_from(docs, labels))).where(F.col(name) >= least).drop(name)


def op2_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score(docs, fit_from(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
