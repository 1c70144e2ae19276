"""Index, caches, audits, whole files, sketches and session findings on literal rows."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.functions import claims as C
from claimloom.functions import text as T
from claimloom.operators import detectors as D
from claimloom.operators import maintenance as M
from claimloom.operators import scans as S
from claimloom.operators.gram_index import GramIndex
from claimloom.plans import staging
from claimloom.plans.staging import new_path
from claimloom.sources import whole_files as W
from claimloom.streaming import events as V
from tests.graphs import AS_OF, CLAIMS, EDGES, NOW, Graphs


def test_index_answers_as_a_scan_does_and_reads_its_own_slots(spark):
    r = random.Random(3)
    g = Graphs()
    for i in range(120):
        g.claim(f"p{i % 3}", f"n{i}", "vibes" if i % 2 else "research", *(["archived"] if i % 7 == 0 else []), text=" ".join(r.choice(["Alpha%", "beta_x", "Gamma", "ab", "été", "delta"]) for _ in range(r.randint(0, 6))), age_days=i)
    claims = spark.createDataFrame(g.claims, CLAIMS)
    index = GramIndex(spark, new_path(spark, "index"), slots=16)
    index.append(claims.where("id < 'p1'"))
    index.append(claims.where("id >= 'p1'"))
    for text, project, basis in (("ALPHA%", None, None), ("beta_x gamma", "p1", None), ("été d", None, "vibes"), ("ab", "p2", None), ("none of it", None, None), ("a b", None, None), ("", "p0", None)):
        want = {x["id"] for x in S.search_claims(claims, text, project, basis).collect()}
        assert {x["id"] for x in index.search(claims, text, project, basis).collect()} == want
    plan = index.candidates("beta")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters")[1].split("]")[0] and "In(gram" in plan or "EqualTo(gram" in plan
    probes = spark.createDataFrame([("p1", None, "gamma beta_x"), ("p0", "p0.n3", "Alpha% ab"), ("p2", None, "ab"), ("p1", None, g.claims[4][1])], "project string, from_id string, needle string")
    both = [sorted(map(tuple, S.resolve_text(probes, claims, i).collect()), key=str) for i in (None, index)]
    assert both[0] == both[1]
    # a revised text is appended again; the old one is no answer any more
    revised = claims.withColumn("text", F.when(F.col("id") == "p1.n1", "wholly new words").otherwise(F.col("text")))
    index.append(revised.where("id = 'p1.n1'"))
    assert [x["id"] for x in index.search(revised, "new words").collect()] == ["p1.n1"]


def test_whole_files_good_torn_and_empty(spark, tmp_path):
    good = {"k1": {"snippet": "s", "source": "u", "failed": False, "fetched_at": "2024-01-01T00:00:00Z"}, "k2": {"failed": True}}
    whole = json.dumps(good)
    for name, text in (("good", whole), ("torn", whole[:-9]), ("tail", whole + "x"), ("two", whole + "," + whole), ("empty", ""), ("blank", " \n"), ("array", "[1]"), ("none", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    read = W.verify_caches(spark, str(tmp_path))
    assert sorted((r["key"], r["snippet"], r["failed"]) for r in read.parsed.collect()) == [("k1", "s", False), ("k2", None, True)]
    assert {r["path"].rsplit("/", 1)[1]: r["corrupt"] for r in read.files.collect()} == {"good.json": False, "torn.json": True, "tail.json": True, "two.json": True, "blank.json": False, "array.json": True, "none.json": False}


def test_samples(spark, tmp_path):
    episode = {"source_file": "e1", "transcript": [{"role": "user", "content": "hi"}], "gold_claims": {"20": "b", "10": "a"}, "gold_relations": [{"from_id": "20", "to_id": "10", "relation": "supports", "x": 1}, {"from_id": "20", "to_id": "99", "relation": "supports"}], "stats": {"ra": 1}}
    (tmp_path / "samples.json").write_text(json.dumps([episode], indent=2))
    (tmp_path / "torn.json").write_text(json.dumps([episode])[:-3])
    s = W.evaluation_samples(spark, str(tmp_path))
    assert [tuple(r) for r in s.transcripts.collect()] == [("e1", 0, "user", "hi")]
    assert sorted(map(tuple, s.claims.collect())) == [("e1", 0, "10", "a"), ("e1", 1, "20", "b")]
    assert [tuple(r) for r in s.relations.collect()] == [("e1", 0, 1, 0, "supports")]
    assert [r["path"].rsplit("/", 1)[1] for r in s.files.where("corrupt").collect()] == ["torn.json"]


def test_extraction_cache(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("h", "m", 1, "{}", at(1)), ("h", "m", 1, '{"new": 1}', at(2)), ("h", "m", 2, '{"torn', at(1)), ("h", "other", 1, "[1]", at(1))]
    cache = spark.createDataFrame(rows, "content_hash string, model string, prompt_version int, result string, created_at timestamp_ntz")
    asked = spark.createDataFrame([("h", "m", 1), ("h", "m", 2), ("h", "other", 1), ("x", "m", 1)], "content_hash string, model string, prompt_version int")
    got = M.cached_extractions(asked, cache)
    assert {tuple(r)[:3]: (r["result"], r["torn"]) for r in got.collect()} == {("h", "m", 1): ('{"new": 1}', False), ("h", "m", 2): (None, True), ("h", "other", 1): (None, True), ("x", "m", 1): (None, False)}
    assert M.delete_extractions(cache, got.where("torn")).count() == 2


def test_upsert_takes_one_row_a_key(spark):
    table, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (2, "y"), (3, None)], "k int, v string")
    assert sorted(map(tuple, M.upsert(table, new, ["k"]).collect())) == [(1, "a"), (2, "y"), (3, None)]


def test_audits(spark):
    g = Graphs().claim("p", "a", session="s1").claim("p", "b", session="s2").claim("q", "c", session="s1").edge("p", "a", "supports", "b")
    graph = g.graph(spark)
    found = spark.createDataFrame([("p", "orphan", "info"), ("p", "load_bearing_vibes", "critical"), ("p", "orphan", "info"), ("p", "strength_x", "critical")], "project string, type string, severity string")
    rows = M.audits_of(graph, found, graph.claims.select("project", "session_id"), AS_OF)
    assert {(r["project"], r["session_id"], r["findings"], r["claim_count"], r["edge_count"], r["critical_count"]) for r in rows.collect()} == {
        ("p", "s1", "load_bearing_vibes=1, orphan=2, strength_x=1", 2, 1, 1), ("p", "s2", "load_bearing_vibes=1, orphan=2, strength_x=1", 2, 1, 1), ("q", "s1", "", 1, 0, 0)
    }
    log = M.append_audits(rows.limit(0), rows)
    assert M.append_audits(log, rows).count() == 3 and M.without_project(log, "p").count() == 1


def test_session_findings(spark):
    g = Graphs()
    for i in range(4):
        g.claim("p", f"m{i}", session="s", age_days=0).claim("p", f"o{i}", session="t", age_days=0)
    g.claim("p", "shut", "vibes", "closed", session="s", age_days=0).claim("p", "older", session="s", age_days=2).claim("p", "newer", session="s", age_days=1).claim("p", "hidden", "vibes", "archived", session="s")
    for i in (1, 2, 3):
        g.edge("p", "m0", "supports", f"m{i}").edge("p", "m1", "supports", f"o{i}")
    g.edge("p", "shut", "supports", "m1").edge("p", "newer", "contradicts", "older").edge("p", "older", "supports", "m1").edge("p", "hidden", "supports", "m2")
    claims, edges = spark.createDataFrame(g.claims, CLAIMS), spark.createDataFrame(g.edges, EDGES)
    bridge = claims.select("session_id", F.col("id").alias("claim_id"))
    got = D.session_findings(claims, edges, bridge, "s", AS_OF).collect()
    assert {("load_bearing_vibes", "p.m0"), ("orphan", "p.newer")} <= {(r["type"], r["anchor_id"]) for r in got}
    named = {x for r in got for x in (r["claim_ids"] or "").split(",")}
    assert not named & {"p.shut", "p.older", "p.hidden", *{f"p.o{i}" for i in range(4)}}
    assert D.session_findings(claims, edges, bridge, "nowhere", AS_OF).count() == 0 and NOW


@pytest.mark.parametrize("k", [200, 800])
def test_sketches_merge_within_their_rank_error_in_any_order(spark, k):
    r = np.random.default_rng(4)
    rows = [(kind, int(day), float(v)) for kind, n in (("a", 30_000), ("b", 3000), ("one", 1)) for day, v in zip(r.integers(0, 9, n), r.exponential(100, n))] + [("a", 0, None)]
    daily = V.quantile_sketches(spark.createDataFrame(rows, "kind string, day int, value double"), ["kind", "day"], k=k)
    shares = (0.01, 0.5, 0.9, 0.99)
    steps = daily.groupBy("kind", (F.col("day") % 2).alias("half")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    for told in (V.merged_quantiles(daily, ["kind"], shares), V.merged_quantiles(steps, ["kind"], shares), V.merged_quantiles(daily.orderBy(F.desc("day")), ["kind"], shares)):
        got = {x["kind"]: x for x in told.collect()}
        assert {x: got[x]["n"] for x in got} == {"a": 30_000, "b": 3000, "one": 1}
        for kind in ("a", "b"):
            values = np.sort([v for x, _, v in rows if x == kind and v is not None])
            for q in shares:
                rank = np.searchsorted(values, got[kind][f"p{q * 100:g}"], "right") / len(values)
                assert abs(rank - q) < 3.5 / k + 1 / len(values), (kind, q, rank)


def test_reminder(spark):
    assert spark.range(1).select(T.reminder_wrapped(F.lit(" f"), F.lit("m "))).first()[0] == "<system-reminder>\nf\n</system-reminder>\n\nm"
    rows = spark.createDataFrame([("doc:1",), ("s",), (None,)], "session_id string")
    assert [r[0] for r in rows.select(C.origin_tag()).collect()] == [" [doc-origin]", "", ""]


def test_old_staged_tables_are_swept(spark):
    kept = staging.stage(spark.range(3), "sweep-test")
    assert staging.sweep_staged(spark, hours=1) >= 0 and kept.df.count() == 3
    assert os.path.exists(kept.path)
    os.utime(kept.path, (1_600_000_000, 1_600_000_000))
    assert staging.sweep_staged(spark, hours=24 * 365) >= 1 and not os.path.exists(kept.path)
