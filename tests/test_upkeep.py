"""Changes, sweeps, notification and streams."""

import datetime as dt

from pyspark.sql import functions as F

from claimloom.operators import detectors as D
from claimloom.operators import maintenance as M
from claimloom.plans.components import connected_components
from claimloom.streaming import events as V
from tests.graphs import AS_OF, EDGES, NOW, Graphs


def test_components(spark):
    pairs = [(i, i + 1) for i in range(300, 340)] + [(1, 2), (2, 3), (9, 9), (5, None), (7, 3), (50, 51)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {**{i: 300 for i in range(300, 341)}, 1: 1, 2: 1, 3: 1, 7: 1, 50: 50, 51: 50}


def test_prune_and_merge(spark):
    g = Graphs()
    for i in range(9):
        g.claim("p", f"n{i}")
    for i, (rel, s) in enumerate([("supports", 1.0), ("supports", 0.5), ("depends_on", 0.1), ("contradicts", 0.1), ("questions", 0.1), ("supports", 0.9), ("depends_on", 0.2)]):
        g.edge("p", "n0", rel, f"n{i + 1}", s)
    graph = g.graph(spark)
    kept = {r["to_id"][-1] for r in M.prune_edges(graph.all_edges).collect()}
    assert kept == {"4", "5", "7", "3", "1"}
    merges = spark.createDataFrame([("p.n1", "p.n2"), ("p.n0", "p.n3")], "absorb string, keep string")
    claims, edges = M.merge_claims(graph.all_claims, graph.all_edges, merges)
    assert claims.count() == 7
    left = {(r["from_id"], r["to_id"], r["relation"]) for r in edges.collect()}
    assert ("p.n3", "p.n3", "depends_on") not in left and len([e for e in left if e[1] == "p.n2"]) == 1


def test_supersede(spark):
    g = Graphs().claim("p", "old", age_days=3).claim("p", "new", age_days=1).claim("p", "same", age_days=1).edge("p", "new", "contradicts", "old").edge("p", "old", "contradicts", "new").edge("p", "same", "contradicts", "new")
    graph = g.graph(spark)
    assert {r["id"]: r["closed"] for r in M.close_superseded(graph.all_claims, graph.all_edges).collect()} == {"p.old": True, "p.new": False, "p.same": False}


def test_sweep_and_legacy_don_t_overlap(spark):
    g = Graphs()
    for age in (29, 30, 31):
        for idle in (6, 7, 8, 29, 30):
            for n in (0, 1, 2):
                p = f"a{age}i{idle}n{n}"
                g.claim(p, "a", age_days=age, idle_days=min(age, idle))
                for i in range(n):
                    g.claim(p, f"d{i}", "research").edge(p, f"d{i}", "supports", "a")
    graph = g.graph(spark)
    swept = {r["id"] for r in M.sweep_candidates(graph).collect()}
    legacy = {r["anchor_id"] for r in D.legacy_load_bearer(graph).collect()}
    assert swept == {f"a{a}i30n{n}.a" for a in (30, 31) for n in (0, 1)}
    assert legacy == {f"a{a}i{i}n2.a" for a in (30, 31) for i in (6, 7)}
    capped = M.sweep_capped(graph, cap=0)
    assert capped.count() == len(swept)


def test_sweep_due(spark):
    hours = {"never": None, "future": -5, "now": 0, "soon": 23, "due": 24}
    rows = [(p, None if h is None else NOW - dt.timedelta(hours=h)) for p, h in hours.items()]
    got = {r["project"]: r["due"] for r in M.sweep_due(spark.createDataFrame(rows, "project string, swept_at timestamp_ntz"), AS_OF).collect()}
    assert got == {"never": True, "future": True, "now": False, "soon": False, "due": True}


def test_hook(spark):
    g = Graphs()
    for p, age in (("fresh", 1), ("old", 8)):
        for i in range(6):
            g.claim(p, f"n{i}", age_days=age)
    g.claim("few", "n0", age_days=1)
    g.claim("fresh", "flagged", "vibes", "sentience_claim", age_days=1)
    rows = [(p, t, "warning", a, a, lasting, 1, s) for p, t, a, lasting, s in [
        ("fresh", "load_bearing_vibes", "fresh.n0", False, 0), ("fresh", "fluency_trap", "fresh.flagged", False, 3), ("fresh", "orphan", "fresh.n1", False, 17), ("fresh", "strength_x", "fresh.n2", False, 14),
        ("fresh", "bottleneck", "fresh.n3", False, 1), ("fresh", "legacy_load_bearer", "fresh.n4", True, 8), ("fresh", "echo_chamber", None, False, 6),
        ("old", "fluency_trap", "old.n0", False, 3), ("old", "load_bearing_vibes", "old.n1", True, 0), ("few", "fluency_trap", "few.n0", False, 3),
    ]]
    found = spark.createDataFrame(rows, "project string, type string, severity string, anchor_id string, claim_ids string, persistent boolean, measure long, seq int")
    ago = lambda hours: NOW - dt.timedelta(hours=hours)
    fires = spark.createDataFrame([("fresh.n3", "bottleneck", ago(23)), ("fresh.n4", "legacy_load_bearer", ago(100)), ("fresh.n0", "load_bearing_vibes", ago(25)), ("old.n1", "load_bearing_vibes", ago(169))], "claim_id string, type string, fired_at timestamp_ntz")
    got = [(r["project"], r["place"], r["anchor_id"]) for r in M.select_for_hook(g.graph(spark), found, fires).orderBy("project", "place").collect()]
    assert got == [("fresh", 1, "fresh.flagged"), ("fresh", 2, "fresh.n0"), ("fresh", 3, None), ("old", 1, "old.n1")]


def test_insert_edges(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "supports", 1.0, NOW)], EDGES)
    new = spark.createDataFrame([("e2", "a", "b", "supports", 0.3, NOW), ("e3", "a", "b", "questions", 0.0, NOW), ("e4", "a", "b", "questions", 0.7, NOW)], EDGES)
    assert {(r["id"], r["strength"]) for r in M.insert_edges(edges, new).collect()} == {("e1", 1.0), ("e3", 1.0)}


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i * 7), i % 9, "click" if i % 2 else "view", float(i)) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    for part in range(3):
        events.where(F.col("event_id").between(part * 200, part * 200 + 199)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = V.event_stream(spark, f"{tmp_path}/in", events.schema)
    whole = V.tumbling(events)
    streamed = V.run_to_table(V.tumbling(stream), "tumbling")
    closed = {tuple(r) for r in streamed.collect()}
    every = {tuple(r) for r in whole.collect()}
    assert closed <= every and len(every - closed) <= 4  # the last windows stay open
    wanted = events.selectExpr("concat('c', user_id) as claim_id", "event_type as type", "ts as fired_at", "event_id % 3 = 0 as persistent")
    asked = stream.selectExpr("concat('c', user_id) as claim_id", "event_type as type", "ts as fired_at", "event_id % 3 = 0 as persistent")
    assert {tuple(r) for r in V.run_to_table(V.cooldown(asked).coalesce(1), "cooldown").collect()} == {tuple(r) for r in V.cooldown(wanted).collect()}


def test_queries_have_their_columns(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == entry.queries()["detect_load_bearing_vibes"](spark, "/root/testdata/sf0.001").columns and entry.entry(spark).count() > 0
