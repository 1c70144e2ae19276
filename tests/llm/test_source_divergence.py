import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from claimloom.llm import features
from claimloom.llm import source_divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, min_docs, top):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in docs]
    in_docs, counts, groups = Counter(), Counter(), {(lang, source) for lang, source, _ in rows}
    for lang, source, terms in rows:
        in_docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept, sources = [t for (x, t), n in in_docs.items() if x == lang and n >= min_docs], sorted(s for x, s in groups if x == lang)

        def shares(of):
            total = sum(of(t) for t in kept)
            return {t: 1 + 10**9 * (of(t) + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(lambda t: counts[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(counts[lang, s, t] for s in sources))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in sources if o != s]
            leading = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", leading, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def random_docs(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "bb", "é", "É", "日本", "z-z", "x1y", "The", "the", "café", "q" * 40, "tie", "eit"]
    out = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "de", None, ""]), r.choice(["s0", "s0", "s1", "s2", None, "é"])
        text = r.choice([None, "", " \n"]) if r.random() < 0.1 else " ".join(r.choice(words[: r.randint(2, len(words))]) for _ in range(r.randint(1, 30)))
        out.append((lang, source, text))
    return out + [("xx", "alone", "no pairs here"), ("yy", "s1", None), ("yy", "s2", ""), ("en", "silent", None)] + [("en", "s0", "copied text")] * 50


def test_equals_brute_force(spark):
    for seed, min_docs, top in ((1, 10, 10), (2, 1, 3), (3, 40, 2), (4, 10_000, 10)):
        docs = random_docs(seed, 120)
        frame = spark.createDataFrame(docs, "lang string, source string, text string").selectExpr("*", "1 as term", "'p' as part", "2 as n", "3 as value").repartition(6)
        got = sorted(tuple(r) for r in op.divergence(frame, min_docs, top).collect())
        assert got == brute(docs, min_docs, top)


def test_empty_table(spark):
    none = op.divergence(spark.createDataFrame([], "lang string, source string, text string"))
    assert none.columns == ["lang", "source", "part", "item", "value", "rank"] and none.count() == 0


def test_more_groups_than_allowed_raise(spark):
    frame = spark.createDataFrame([("en", f"s{i}", "a") for i in range(5)], "lang string, source string, text string")
    try:
        op.divergence(frame, max_groups=4)
    except ValueError as told:
        assert "max_groups" in str(told)
    else:
        raise AssertionError


def test_counts_are_sent_on_and_terms_go_on_across_batches(monkeypatch):
    monkeypatch.setattr(op, "HELD", 3)
    docs = [(lang or "", source or "", text or "") for lang, source, text in random_docs(9, 60)]
    batches = [pa.RecordBatch.from_pydict({"lang": [d[0] for d in part], "source": [d[1] for d in part], "text": [d[2] for d in part]}) for part in (docs[:20], docs[20:21], docs[21:])]
    rows = sorted((r for b in op.count_terms(iter(batches)) for r in b.to_pylist()), key=lambda r: (r["lang"], r["term"]))
    want, in_docs = Counter(), Counter()
    for lang, source, text in docs:
        terms = TERM.findall(text.translate(LOWER))
        want.update((lang, source, t) for t in terms)
        in_docs.update((lang, t) for t in set(terms))
    found = Counter()
    for r in rows:
        found[r["lang"], r["source"], r["term"]] += r["n"]
    assert found == want
    ones = [pa.RecordBatch.from_pylist([r], schema=op._COUNTS) for r in rows]
    kept = defaultdict(dict)
    for b in op.keep_terms(5)(iter(ones)):
        for r in b.to_pylist():
            assert (r["lang"], r["term"]) not in kept
            kept[r["lang"], r["term"]] = dict(zip(r["sources"], r["counts"]))
    assert kept == {k: {s: n for (x, s, t), n in want.items() if (x, t) == k} for k, d in in_docs.items() if d >= 5}


def test_counts_are_sent_on_between_blocks_of_one_batch(monkeypatch):
    monkeypatch.setattr(op, "HELD", 3)
    monkeypatch.setattr(features, "AT_ONCE", 40)
    docs = [(lang or "", source or "", text or "") for lang, source, text in random_docs(11, 80)]
    batch = pa.RecordBatch.from_pydict({"lang": [d[0] for d in docs], "source": [d[1] for d in docs], "text": [d[2] for d in docs]})
    found, want = Counter(), Counter()
    for b in op.count_terms(iter([batch])):
        for r in b.to_pylist():
            found[r["lang"], r["source"], r["term"]] += r["n"]
    for lang, source, text in docs:
        want.update((lang, source, t) for t in TERM.findall(text.translate(LOWER)))
    assert found == want
