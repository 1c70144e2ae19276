"""Held-out accuracy, and the defined results of odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import language_id, quality_knn


def sentence(rng, syllables, n=60):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


SYLLABLES = {
    "en": ["the", "ing", "and", "tion", "er", "ed", "wh", "ou"],
    "de": ["sch", "ung", "keit", "ein", "der", "ä", "ich", "pf"],
    "fr": ["eau", "tion", "le", "é", "oui", "ment", "que", "ç"],
    "es": ["ción", "ado", "el", "que", "ñ", "mente", "os", "ar"],
}


def test_quality(spark):
    rng = random.Random(3)
    good = [sentence(rng, SYLLABLES[rng.choice(list(SYLLABLES))], rng.randint(8, 90)) for _ in range(260)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(rng, SYLLABLES["en"], rng.randint(8, 90)).split()) for _ in range(60)]
    texts = good + bad
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(900, None, "x", 1.0), (901, "", "x", 1.0), (0, texts[0], "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(i < 260), 0) for i in range(320)] + [(5, None, 0), (None, 1, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_knn.fit_from(docs, labels)
    out = docs.select("doc_id", (quality_knn.fold("doc_id", 4) == 2).alias("held"), quality_knn.score(docs, model).alias("s")).collect()
    assert len(out) == len(rows) and all(0 <= r["s"] <= 1 for r in out)
    held = [(r["s"] >= 0.7) == (r["doc_id"] < 260) for r in out if r["held"] and r["doc_id"] < 320]
    assert len(held) > 40 and sum(held) / len(held) > 0.97
    kept = quality_knn.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality_knn.score(docs, quality_knn.fit_from(docs, labels.limit(0))) is not None
    assert docs.limit(0).select(quality_knn.score(docs, model)).count() == 0
    assert docs.select(quality_knn.score(docs, None).alias("s")).where(F.col("s") == 1).count() == len(rows)


def test_language(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, SYLLABLES[lang], rng.randint(4, 80)), lang, "lang") for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(900, None, "en", ""), (901, "", "de", ""), (902, "123 !!! ***", "fr", ""), (903, rows[0][1], None, ""), (904, "ÄSCHUNG" * 9000, "de", "")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, told string")
    model = language_id.fit_from(docs)
    assert set(model.families) == {"germanic", "romance"} and set(model.pairs) == {("de", "en"), ("es", "fr")}
    out = docs.select("doc_id", "lang", (language_id.fold("doc_id", 5) == 0).alias("held"), language_id.identify(docs, model).alias("t")).select("doc_id", "lang", "held", "t.lang", "t.score").collect()
    told = {r[0]: (r[3], r[4]) for r in out}
    assert [told[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert told[903] == told[0] and told[904][0] == "de"
    held = [r[3] == r[1] for r in out if r[2] and r[0] < 900]
    assert len(held) > 40 and sum(held) / len(held) > 0.97
    empty = docs.limit(0)
    assert language_id.fit_from(empty) is None
    assert docs.select(language_id.identify(docs, None)["lang"].alias("l")).where("l <> 'und'").count() == 0


def plain_scaled(counts, idf):
    x = [math.log1p(float(c)) * float(w) for c, w in zip(counts, idf)]
    for part in (slice(0, 1 << quality_knn.BITS), slice(1 << quality_knn.BITS, None)):
        length = math.sqrt(sum(v * v for v in x[part]))
        x[part] = [v / length if length else v for v in x[part]]
    return np.array(x)


def plain_vote(model, counts):
    """One document against every labelled vector, one cosine after another."""
    z = plain_scaled(counts, model.idf) @ model.axes.astype(np.float64)
    length = math.sqrt(float(z @ z))
    if not length:
        return model.base
    cosines = [float(z @ v.astype(np.float64)) / length for v in model.vectors]
    near = sorted(range(len(cosines)), key=lambda i: -cosines[i])[: model.neighbours]
    good = sum(max(cosines[i], 0) ** model.power for i in near if model.good[i]) * 0.5 / model.base
    bad = sum(max(cosines[i], 0) ** model.power for i in near if not model.good[i]) * 0.5 / (1 - model.base)
    return good / (good + bad) if good + bad else model.base


def test_votes_equal_a_plain_search():
    rng = random.Random(6)
    texts = [sentence(rng, SYLLABLES[rng.choice(list(SYLLABLES))], rng.randint(1, 60)) for _ in range(120)] + ["AB!! " * rng.randint(1, 30) for _ in range(30)]
    counts = np.stack([quality_knn.counts_of(t) for t in texts])
    model = quality_knn.fit(counts, np.array([1] * 120 + [0] * 30), rank=16, neighbours=9, power=8.0)
    asked = np.stack([quality_knn.counts_of(t) for t in [*texts[:10], *texts[-5:], "", None, "x", "New words here, with others."]])
    got = quality_knn.vote(model, asked)
    assert all(abs(g - plain_vote(model, c)) < 2e-3 for g, c in zip(got, asked))


def plain_language(model, counts):
    """The family of the largest weight sum, then every pair's vote in it; margins settle ties."""
    x = np.log1p(counts.astype(np.float64))
    x = np.append(x / (np.linalg.norm(x) or 1), 1.0)
    family = max(range(len(model.families)), key=lambda i: float(x @ model.family_weights[:, i].astype(np.float64)))
    names = model.members[model.families[family]]
    votes, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for (a, b), w in model.pairs.items():
        if a in names:
            m = float(x @ w.astype(np.float64))
            votes[a if m > 0 else b] += 1
            margins[a] += m
            margins[b] -= m
    return max(names, key=lambda n: (votes[n], margins[n]))


def test_languages_equal_plain_votes():
    rng = random.Random(2)
    more = SYLLABLES | {"nl": ["ij", "een", "het", "oo", "sch", "van"], "it": ["zione", "gli", "che", "del", "ato", "io"], "xx": ["qu", "zz", "kk", "vv"]}
    langs = [rng.choice(list(more)) for _ in range(350)]
    counts = np.stack([language_id.counts_of(sentence(rng, more[lang], rng.randint(2, 50))) for lang in langs])
    model = language_id.fit(counts[:250], langs[:250])
    got, scores = language_id.predict(model, counts[250:])
    assert list(got) == [plain_language(model, c) for c in counts[250:]]
    assert sum(g == w for g, w in zip(got, langs[250:])) > 90 and ((scores >= 0) & (scores <= 1)).all()


def test_more_languages_than_rows_raise(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="max_rows"):
        language_id.fit_from(docs, max_rows=5)


def test_repeated_ids_count_once(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, SYLLABLES["en" if i % 2 else "de"]), "en" if i % 2 else "de") for i in range(60)]
    copies = [rows[7]] * 500 + [(7, f"zz other text {i}", "en") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    once, often = (spark.createDataFrame(r, "doc_id long, text string, lang string") for r in (rows, rows + copies))
    quality = [quality_knn.fit_from(d, labels, held_out=9) for d in (once, often)]
    assert len(quality[0].vectors) == len(quality[1].vectors) == 60
    assert (quality[0].vectors == quality[1].vectors).all()
    assert len(quality_knn.fit_from(often, labels, held_out=9, max_labelled=20).vectors) == 20
    seen = []
    fit, language_id.fit = language_id.fit, lambda counts, names: seen.append((counts.tolist(), names)) or fit(counts, names)
    try:
        for d in (once, often):
            language_id.fit_from(d, held_out=9, max_rows=40)
    finally:
        language_id.fit = fit
    assert seen[0] == seen[1] and sorted(seen[0][1]) == ["de"] * 20 + ["en"] * 20
