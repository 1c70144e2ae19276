import random

import numpy as np
from pyspark.sql import functions as F

from claimloom.operators import asked_runs, scans


def test_windows_pick_few_runs_and_those_of_what_they_hold(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(("th", "an", "er ", "é", "日", "\U0001f600")) for _ in range(r.randint(0, 150))) for _ in range(60)]
    parts = [(k, t, t[(at := r.randint(0, max(0, len(t) - 16))) : at + 16]) for k, t in enumerate(texts)]
    rows = spark.createDataFrame(parts, "k int, text string, part string").select("text", "part", scans.window_runs(F.col("text")).alias("all"), scans.window_runs(F.col("part")).alias("one")).collect()
    runs = 0
    for row in rows:
        if len(row["text"]) < 16:
            assert row["all"] is None and row["one"] is None
        else:
            assert len(row["one"]) == 1 and row["one"][0] in row["all"]
            runs += len({row["text"][i : i + 12] for i in range(len(row["text"]) - 11)})
    assert sum(len(row["all"] or ()) for row in rows) < runs / 2


def test_resolved_like_a_plain_search(spark):
    r = random.Random(6)
    text = lambda: "".join(r.choice(("Th", "an", "er ", "ou")) for _ in range(r.randint(1, 30)))
    claims = [(f"c{k}", f"p{k % 2}", text(), False, k % 3) for k in range(60)]
    probes = [(p, i, t[a : a + n]) for i, p, t, _, _ in claims for a, n in ((0, 24), (3, 10), (0, 5), (0, 2), (2, 40))]
    got = scans.resolve_text(spark.createDataFrame(probes, "project string, from_id string, needle string"), spark.createDataFrame(claims, "id string, project string, text string, archived boolean, created_at int")).collect()
    found = {(x["project"], x["from_id"], x["needle"]): x["claim_id"] for x in got}
    for p, i, needle in probes:
        key = needle.strip(" ").lower()
        if not key:
            continue
        same = [(at, c) for c, q, t, _, at in claims if q == p and t.lower() == key]
        inside = [c for c, q, t, _, _ in claims if q == p and key in t.lower()]
        means = min(same)[1] if same else inside[0] if len(inside) == 1 else None
        assert found[p, i, needle] == (None if means == i else means)


def test_exploded_runs_are_never_broadcast(spark, monkeypatch):
    """Spark sizes what is exploded by its input, so a small table's many runs went to the driver."""
    plans = []
    monkeypatch.setattr(scans, "stage", lambda df, name, f=scans.stage: plans.append(df) or f(df, name))
    r = random.Random(7)
    claims = [(f"c{k}", "p", "".join(r.choice(("Th", "an", "er ", "ou")) for _ in range(r.randint(1, 200))), False, k) for k in range(40)]
    probes = [("p", i, t[:n]) for i, _, t, _, _ in claims for n in (3, 9, 24, 40)]
    found = scans.resolve_text(spark.createDataFrame(probes, "project string, from_id string, needle string"), spark.createDataFrame(claims, "id string, project string, text string, archived boolean, created_at int"))
    for df in (found, *plans):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_texts_give_the_asked_runs_that_they_hold_alone(monkeypatch):
    r = random.Random(8)
    text = lambda n: "".join(r.choice(("th", "an", "er ", "é", "日", "\U0001f600")) for _ in range(r.randint(0, n)))
    monkeypatch.setattr(asked_runs, "BLOCK", 100)
    texts, apart = [*(text(60) for _ in range(50)), None, text(400)], np.arange(52) % 2
    runs = {t[a : a + n] for t in texts[:9] if t for a, n in ((0, 3), (1, 1), (2, 12), (5, 24), (9, 16)) if len(t) >= a + n}
    marks = np.zeros(1 << (asked_runs.BITS - 3), np.uint8)
    for run in runs:
        for (at,) in asked_runs._places(asked_runs._Hashed([run], np.zeros(1, np.int64)).of(len(run))):
            marks[at >> 3] |= 1 << (at & 7)
    lengths = sorted({len(run) for run in runs})
    got = dict(asked_runs.runs_in(texts, apart, lengths, marks))
    for k, t in enumerate(texts):
        held = sorted(run for run in runs if t and run in t) if apart[k] == 0 else []
        assert sorted(got.get(k, [])) == held
