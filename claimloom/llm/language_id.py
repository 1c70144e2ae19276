"""Language identification by hierarchical discrimination.

A language family is predicted first (softmax regression); within a family of
several languages, one-versus-one linear support vector machines vote. All weights
are fitted on the driver from a sample of at most ``max_rows`` learned rows, a bound
that doesn't grow with the input; the models that are broadcast are a few matrices.
Input are the hashed byte trigrams and words of the whole lower-cased text.

Defined results: text that is null or has no letter gives ``und`` with score 0; with
no rows to learn from every text is ``und``. Repeated rows are predicted alike. Other
columns are ignored. A learned language outside ``FAMILIES`` is a family of its own.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.features import gram_counts, packed_counts, unpacked_counts

#: Families of closely related languages.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
BITS = 12
_LETTER = regex.compile(r"\p{L}")


class Fitted(NamedTuple):
    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), lang)


def counts_of(text: str | None) -> np.ndarray:
    data = b" " + text.lower().encode("utf-8", "surrogatepass") + b" " if text else b""
    return gram_counts(data, BITS)


def _scaled(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(length > 0, length, 1)
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 150, rate: float = 8.0, ridge: float = 1e-4) -> np.ndarray:
    """Class-balanced softmax regression by accelerated gradient steps from zero."""
    w = np.zeros((x.shape[1], classes), np.float32)
    ahead, target = w, np.eye(classes, dtype=np.float32)[y]
    share = np.bincount(y, minlength=classes)
    weight = (len(y) / (classes * np.maximum(share, 1)))[y][:, None].astype(np.float32)
    for step in range(rounds):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - rate * (x.T @ ((p - target) * weight) / len(y) + ridge * ahead)
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return w


def _svm_fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-4, rate: float = 4.0) -> np.ndarray:
    """A linear support vector machine (squared hinge, class-balanced) for ``y`` in -1, 1."""
    w = np.zeros(x.shape[1], np.float32)
    ahead = w
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-6), 0.5 / max((y < 0).mean(), 1e-6)).astype(np.float32)
    for step in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead)) * weight
        new = ahead - rate * (ridge * ahead - x.T @ (slack * y) / len(y))
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return w


def fit(counts: np.ndarray, langs: list[str]) -> Fitted:
    x = _scaled(counts)
    names = np.array(langs)
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    y = np.array([families.index(family_of(lang)) for lang in langs])
    pairs = {}
    for langs_in in members.values():
        for a, b in combinations(langs_in, 2):
            rows = (names == a) | (names == b)
            pairs[a, b] = _svm_fit(x[rows], np.where(names[rows] == a, 1, -1).astype(np.float32))
    return Fitted(families, members, _softmax_fit(x, y, len(families)), pairs)


def predict(model: Fitted, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of a block of rows."""
    x = _scaled(counts)
    z = x @ model.family_weights
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    langs, scores = np.empty(len(x), object), p.max(axis=1).astype(np.float64)
    for i, family in enumerate(model.families):
        rows = np.flatnonzero(best == i)
        names = model.members[family]
        if not len(rows):
            continue
        wins, margin = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
        for a, b in combinations(range(len(names)), 2):
            m = x[rows] @ model.pairs[names[a], names[b]]
            wins[:, a] += m > 0
            wins[:, b] += m <= 0
            margin[:, a] += m
            margin[:, b] -= m
        # margins settle ties of votes
        pick = (wins + 0.5 * np.tanh(margin / max(1, len(names)))).argmax(axis=1)
        langs[rows] = np.array(names, object)[pick]
        sure = 1 / (1 + np.exp(-2 * margin[np.arange(len(rows)), pick] / max(1, len(names) - 1)))
        scores[rows] *= sure if len(names) > 1 else 1
    return langs, scores


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def fit_from(docs: DataFrame, held_out: int = 0, folds: int = 5, max_rows: int = 6000) -> Fitted | None:
    """The models of at most ``max_rows`` ids outside the held-out fold, one text (the least) of each, in the order of a hash, each language alike.

    Raises where there are more languages than ``max_rows``, rather than leave one out.
    """
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(fold("doc_id", folds) != held_out)
    ids = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    counted = {r["lang"]: max(1, r["n"]) for r in ids.orderBy("lang").limit(max_rows + 1).collect()}
    if not counted:
        return None
    if len(counted) > max_rows:
        raise ValueError(f"more than {max_rows} languages; raise max_rows")
    each = max_rows // len(counted)
    # the first by hash are among those under a bar that lets several times as many through, so only these are sorted
    bars = F.create_map(*[F.lit(x) for lang, n in counted.items() for x in (lang, min(1.0, (4 * each + 100) / n))])
    place = (F.xxhash64("doc_id") / 2.0**64) + 0.5
    keys = known.where(place <= F.element_at(bars, F.col("lang"))).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = keys.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= each).select("doc_id", "lang")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([packed_counts(counts_of(t)) for t in texts])

    # at most max_rows keys, so this side is bounded; one text a key, so the rows fetched are too
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sample.select("lang", packed("text").alias("x")).toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    return fit(unpacked_counts(rows.column("x").to_pylist(), 1 << BITS), rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: Fitted | None) -> Column:
    """``struct(lang, score)`` of column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        for at in range(0, len(texts) if shared.value else 0, 512):
            rows = [i for i, t in enumerate(texts.iloc[at : at + 512], at) if t and _LETTER.search(t)]
            if rows:
                langs[rows], scores[rows] = predict(shared.value, np.stack([counts_of(texts.iloc[i]) for i in rows]))
        return pd.DataFrame({"lang": langs, "score": scores})

    return of(F.col("text"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    told = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), identify(docs, fit_from(docs)).alias("told"))
    return told.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))
