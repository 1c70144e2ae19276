"""Strong components, chains above cycles, betweenness in rounds and bit-packed depths, against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import detectors as D
from claimloom.plans import staging
from claimloom.plans.betweenness import _in_tasks, betweenness
from claimloom.plans.claim_graph import ClaimGraph
from claimloom.plans.strong import strongly_connected
from tests.graphs import AS_OF, Graphs
from tests.test_detectors import brandes


def reach(edges, start):
    seen, stack = {start}, [start]
    while stack:
        x = stack.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def test_strong_components(spark):
    r = random.Random(1)
    edges, want = [], {}
    for k in range(12):
        n = r.randint(2, 14)
        own = [(100 * k + r.randrange(n), 100 * k + r.randrange(n)) for _ in range(r.randint(1, 2 * n))]
        edges += own
        far = {v: reach([e for e in own if e[0] != e[1]], v) for v in {x for e in own for x in e}}
        for v in far:
            mine = {w for w in far[v] if v in far[w]}
            if len(mine) > 1:
                want[v] = min(mine)
    frame = spark.createDataFrame([*edges, (None, 1), (5000, None), edges[0]], "src long, dst long")
    got = strongly_connected(frame)
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want) > 10
    assert strongly_connected(frame.limit(0)).count() == 0 and strongly_connected(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).count() == 0


def test_a_long_way_above_a_cycle_costs_rounds_not_paths(spark):
    """Nine levels of two claims, each of which rests on both of the next, would be hundreds of paths."""
    g = Graphs()
    for i in range(9):
        for side in "ab":
            g.claim("p", f"t{i:02}{side}")
    for c in "xyz":
        g.claim("p", c)
    for c in "uvw":
        g.claim("p", c)
    for i in range(8):
        for x in "ab":
            for y in "ab":
                g.edge("p", f"t{i:02}{x}", "supports", f"t{i + 1:02}{y}")
    # two cycles, one above the other, with a leaf between
    g.edge("p", "t08a", "supports", "x").edge("p", "t08b", "depends_on", "y")
    g.edge("p", "x", "supports", "y").edge("p", "y", "supports", "z").edge("p", "z", "supports", "x")
    g.claim("p", "between").edge("p", "y", "supports", "between").edge("p", "between", "supports", "u")
    g.edge("p", "u", "supports", "v").edge("p", "v", "supports", "w").edge("p", "w", "supports", "u").edge("p", "v", "supports", "u")
    got = D.unchallenged_chain(g.graph(spark), max_paths=12).collect()
    # from z the first cycle is walked whole, from x its way out comes a claim earlier
    chain = got[0]["claim_ids"].split(",")
    assert len(got) == 1 and chain == [f"p.t{i:02}a" for i in range(8)] + ["p.t08a", "p.x", "p.y", "p.between", "p.u", "p.v", "p.w"]


def _frame(spark, nets):
    rows = {}
    for p, edges in nets.items():
        for a, b in edges:
            if a != b:
                key = (p, min(a, b), max(a, b))
                rows[key] = rows.get(key, 0) + 1
    return spark.createDataFrame([(p, str(a), str(b), n) for (p, a, b), n in rows.items()], "project string, a string, b string, ways long")


def test_betweenness_in_tasks_and_in_rounds(spark):
    r = random.Random(9)
    nets = {"path": [(i, i + 1) for i in range(12)], "star": [(0, i) for i in range(1, 30)], "pair": [(1, 2)], "twice": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 1)]}
    for k in range(3):
        nets[f"net{k}"] = [(r.randrange(18), r.randrange(18)) for _ in range(30)] + [(18 + i, r.randrange(18 + i)) for i in range(10)]
    want = {}
    for p, edges in nets.items():
        inner = [(a, b) for a, b in edges if a != b]
        for v, x in brandes(sorted({x for e in inner for x in e}), inner).items():
            want[p, str(v)] = x
    pairs = _frame(spark, nets)
    for told in (betweenness(pairs), betweenness(pairs, small=0), betweenness(pairs, small=20, folds=2, rows_at_once=1000), _in_tasks(pairs, chunk=3)):
        got = {(x["project"], x["id"]): x["score"] for x in told.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert betweenness(pairs.limit(0)).count() == 0 and betweenness(pairs.limit(0), small=-1).count() == 0


def test_a_star_of_a_million_leaves(spark):
    n = 1_000_000
    pairs = spark.range(n).select(F.lit("p").alias("project"), F.lit("hub").alias("a"), F.concat(F.lit("leaf"), "id").alias("b"), F.lit(1).cast("long").alias("ways"))
    top = betweenness(pairs).agg(F.max_by("id", "score"), F.max("score"), F.count("*"), F.count_if(F.col("score") > 0)).first()
    assert tuple(top) == ("hub", float(n * (n - 1)), n + 1, 1)


def plain_depth(nodes, edges):
    heads = {b for _, b in edges}
    best = 0
    for root in (n for n in nodes if n not in heads):
        depth, front, seen = 0, {root}, {root}
        while front:
            depth += 1
            front = {b for a, b in edges if a in front} - seen
            seen |= front
        best = max(best, depth)
    return best


@pytest.mark.parametrize("bucket", [1 << 16, 50])
def test_depths_of_many_roots(spark, bucket):
    r = random.Random(7)
    g, want = Graphs(), {}
    for k in range(3):
        p, n = f"p{k}", 100
        for i in range(n):
            g.claim(p, f"n{i}")
        edges = {(r.randrange(n), r.randrange(n)) for _ in range([20, 40, 70][k])}
        edges = {(a, b) for a, b in edges if a != b}
        for a, b in sorted(edges):
            g.edge(p, f"n{a}", "supports", f"n{b}")
        want[p] = plain_depth(range(n), edges)
    assert {x["project"]: x["max_depth"] for x in g.graph(spark).depths(bucket=bucket).collect()} == want


def test_depths_stage_words_not_pairs(spark, monkeypatch):
    """6,400 roots above one chain of ten claims are 100 words."""
    claims = spark.range(6410).selectExpr("concat('c', id) as id", "'p' as project", "false as archived")
    edges = spark.range(6409).selectExpr("concat('e', id) as id", "if(id < 6400, concat('c', id), concat('c', id)) as from_id", "if(id < 6400, 'c6400', concat('c', id + 1)) as to_id", "'supports' as relation")
    rows, write = [], staging.stage_told

    def counted(df, name, **told):
        staged, totals = write(df, name, **told)
        rows.append(totals["n"])
        return staged, totals

    monkeypatch.setattr("claimloom.plans.claim_graph.stage_told", counted)
    assert ClaimGraph(claims, edges, AS_OF).depths().first()["max_depth"] == 11
    # the roots as they are found and numbered, then a row a word and claim, where pairs were 6,400 a claim
    assert sum(rows) - 2 * 6400 == 100 * 10
