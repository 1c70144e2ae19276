"""Each detector on literal graphs: what fires, what doesn't, and the edges of its thresholds."""

import random

from claimloom.operators import detectors as D
from tests.graphs import Graphs, by_project


def supported(g, project, anchor, n, age_days=None, sessions=1, basis="vibes", **more):
    g.claim(project, anchor, basis, age_days=age_days, **more)
    for i in range(n):
        g.claim(project, f"d{i}", "deduction", session=f"s{i % sessions}", age_days=age_days).edge(project, anchor, "supports", f"d{i}")


def test_load_bearing(spark):
    g = Graphs()
    supported(g, "two", "a", 2)
    supported(g, "research", "a", 2, basis="research")
    supported(g, "one", "a", 1)
    supported(g, "ancient", "a", 3, age_days=5)
    supported(g, "eight", "a", 8, age_days=5)
    supported(g, "seven", "a", 7, age_days=5)
    supported(g, "spread", "a", 9, age_days=5, sessions=3)
    supported(g, "disputed", "a", 9, age_days=5, sessions=3)
    g.claim("disputed", "x").edge("disputed", "x", "contradicts", "a")
    supported(g, "status", "a", 4, text="All tests pass now")
    g.claim("depends", "a").claim("depends", "b").claim("depends", "c").edge("depends", "b", "depends_on", "a").edge("depends", "c", "depends_on", "a")
    g.claim("hidden", "a").claim("hidden", "b", "vibes", "archived").claim("hidden", "c").edge("hidden", "a", "supports", "b").edge("hidden", "a", "supports", "c")
    got = by_project(D.load_bearing_vibes(g.graph(spark)))
    assert {p: (r[0]["measure"], r[0]["persistent"]) for p, r in got.items()} == {"two": (2, False), "eight": (8, True), "disputed": (9, True), "depends": (2, False)}
    assert all(r["anchor_id"].endswith(".a") and r["severity"] == "critical" for rows in got.values() for r in rows)


def test_fluency(spark):
    g = Graphs()
    for project, basis, confidence in (("over", "vibes", 0.51), ("at", "vibes", 0.5), ("fine", "research", 0.95), ("sure", "definition", 1.0), ("like", "analogy", 0.71)):
        supported(g, project, "a", 1, basis=basis, confidence=confidence)
    g.claim("alone", "a", confidence=0.9)
    supported(g, "asked", "a", 1, confidence=0.9)
    g.claims[-2] = (*g.claims[-2][:11], True, *g.claims[-2][12:])
    assert set(by_project(D.fluency_trap(g.graph(spark)))) == {"over", "like"}


def brandes(nodes, edges):
    """Betweenness by counting all shortest paths, each unordered pair twice."""
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    score = dict.fromkeys(near, 0.0)
    for s in near:
        dist, ways, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], ways[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
        for t in order[1:]:
            back = {t: 1.0}
            for v in sorted(dist, key=dist.get, reverse=True):
                if v in back and v != s:
                    for w in near[v]:
                        if dist.get(w, -1) == dist[v] - 1:
                            back[w] = back.get(w, 0) + back[v] * ways[w] / ways[v]
            for v, x in back.items():
                if v not in (s, t):
                    score[v] += x
    return score


def test_bottleneck(spark):
    rng = random.Random(6)
    g = Graphs()
    for i in range(9):
        g.claim("hub", f"n{i}", *(["vibes", "challenged"] if i == 0 else []))
    for i in range(1, 9):
        g.edge("hub", f"n{i}", "supports", "n0")
    for i in range(7):
        g.claim("small", f"n{i}")
        if i:
            g.edge("small", f"n{i}", "supports", "n0")
    for i in range(9):
        g.claim("old", f"n{i}", age_days=3)
        if i:
            g.edge("old", f"n{i}", "supports", "n0")
    pairs = []
    for i in range(40):
        g.claim("net", f"n{i:02}")
    for _ in range(55):
        a, b = rng.sample(range(40), 2)
        rel = rng.choice(["supports", "questions"])
        if (a, b, rel) not in pairs:
            pairs.append((a, b, rel))
            g.edge("net", f"n{a:02}", rel, f"n{b:02}")
    got = by_project(D.bottleneck(g.graph(spark)))
    assert {p for p in got} <= {"hub", "net"} and got["hub"][0]["severity"] == "info" and got["hub"][0]["measure"] == 56
    score = brandes(range(40), [(a, b) for a, b, _ in pairs])
    values = list(score.values())
    mean = sum(values) / len(values)
    bar = max(1.0, mean + 2 * (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5)
    assert {r["anchor_id"]: r["measure"] for r in got.get("net", [])} == {f"net.n{i:02}": round(v) for i, v in score.items() if v >= bar}


def longest(nodes, steps):
    best = []

    def walk(path):
        nonlocal best
        if (-len(path), path) < (-len(best), best) or not best:
            best = list(path)
        for a, b in steps:
            if a == path[-1] and b not in path:
                walk([*path, b])

    for n in nodes:
        walk([n])
    return best


def test_chains(spark):
    rng = random.Random(4)
    g, want = Graphs(), {}
    for k in range(14):
        p = f"g{k:02}"
        nodes = [f"{p}.n{i}" for i in range(9)]
        bad = set(rng.sample(range(9), 2))
        for i in range(9):
            g.claim(p, f"n{i}", "vibes", *(["challenged"] if i in bad else []))
        steps, pushed = set(), set()
        for _ in range(12 if k < 10 else 6):
            a, b = rng.sample(range(9), 2)
            if k < 5 and a > b:
                a, b = b, a  # without cycles
            rel = rng.choice(["supports", "depends_on", "depends_on", "questions"])
            g.edge(p, f"n{a}", rel, f"n{b}")
            if rel == "questions":
                pushed.add(b)
            else:
                steps.add((f"{p}.n{a}", f"{p}.n{b}"))
        open_nodes = [n for i, n in enumerate(nodes) if i not in bad | pushed]
        chain = longest(open_nodes, [(a, b) for a, b in steps if a in open_nodes and b in open_nodes])
        if len(chain) >= 3:
            want[p] = chain
    got = {r["project"]: r["claim_ids"].split(",") for r in D.unchallenged_chain(g.graph(spark)).collect()}
    assert got == want and len(want) >= 5


def test_clusters(spark):
    g = Graphs()
    for i in range(8):
        g.claim("p", f"a{i}", session="s1", age_days=9)
    for i in range(10):
        g.edge("p", f"a{i % 8}", "contradicts", f"a{(i + 1 + i // 8) % 8}")
    for i in range(3):
        g.claim("p", f"b{i}", session="s2", age_days=1)
    g.edge("p", "b0", "supports", "b1").edge("p", "b0", "supports", "b2")
    graph = g.graph(spark)
    found = {r["anchor_id"]: r for r in D.coverage_imbalance(graph).collect()}
    assert set(found) == {"p.a0", "p.b0"}
    assert [r["anchor_id"] for r in D.abandoned_topic(graph).collect()] == ["p.a0"]


def test_depths(spark):
    g = Graphs()
    for p, edges in {"line": [(0, 1), (1, 2), (0, 2)], "ring": [(0, 1), (1, 2), (2, 0)], "none": []}.items():
        for i in range(3):
            g.claim(p, f"n{i}")
        for a, b in edges:
            g.edge(p, f"n{a}", "supports", f"n{b}")
    assert {r["project"]: r["max_depth"] for r in g.graph(spark).depths().collect()} == {"line": 2, "ring": 0, "none": 1}


def test_echo_chamber(spark):
    g = Graphs()
    for p in ("quiet", "argued"):
        for i in range(10):
            g.claim(p, f"u{i}", "research", session=f"s{i % 2}").claim(p, f"b{i}", "research", session="s0", speaker="assistant")
    g.edge("argued", "u0", "contradicts", "b0")
    for p, asked in (("weak", False), ("asked", True)):
        for i in range(10):
            g.claim(p, f"u{i}", "vibes", *(["challenged"] if asked and i == 0 else []), session=f"s{i % 2}")
    assert set(by_project(D.echo_chamber(g.graph(spark)))) == {"quiet", "weak"}


def test_closure(spark):
    g = Graphs()
    for p, basis, flag in (("both", "vibes", True), ("flag", "deduction", True), ("caps", "vibes", False), ("plain", "deduction", False)):
        g.claim(p, "leaf", basis, *(["terminates_inquiry"] if flag else []))
        g.claim(p, "mid", "research").claim(p, "up", "vibes" if p in ("both", "caps", "plain") else "research")
        g.edge(p, "mid", "supports", "leaf").edge(p, "mid", "depends_on", "up")
    assert {p: r[0]["severity"] for p, r in by_project(D.premature_closure(g.graph(spark))).items()} == {"both": "warning", "flag": "info", "caps": "info"}


def test_legacy(spark):
    g = Graphs()
    for p, age, idle, closed, n, rel in (("fires", 31, 1, 0, 2, "supports"), ("young", 29, 1, 0, 2, "supports"), ("stale", 31, 8, 0, 2, "supports"), ("closed", 31, 1, 1, 2, "supports"), ("few", 31, 1, 0, 1, "supports"), ("against", 31, 1, 0, 2, "contradicts"), ("edge", 30, 7, 0, 2, "depends_on")):
        g.claim(p, "a", "vibes", *(["closed"] if closed else []), age_days=age, idle_days=idle)
        for i in range(n):
            g.claim(p, f"d{i}").edge(p, f"d{i}", rel, "a")
    assert set(by_project(D.legacy_load_bearer(g.graph(spark)))) == {"fires", "edge"}


def test_sessions(spark):
    g = Graphs()
    for i in range(6):
        g.claim("sat", f"b{i}", "llm_output", *(["grand_significance", "unique_connection"][: i % 3]), session="s", turn=i, speaker="assistant")
    g.claim("sat", "u0", "vibes", session="s").claim("sat", "u1", "vibes", session="s")
    for i in range(3):
        g.claim("run", f"b{i}", "vibes", "sentience_claim", session="s", turn=i, speaker="assistant" if i else "user")
        g.claim("cut", f"b{i}", "vibes", "sentience_claim", session="s", turn=i, speaker="assistant")
        g.claim("users", f"b{i}", "vibes", "sentience_claim", session="s", turn=i)
    g.claim("cut", "x", session="t").edge("cut", "x", "questions", "b1")
    for p, flagged, basis in (("crit", 3, "vibes"), ("warn", 3, "research"), ("info", 1, "vibes")):
        g.claim(p, "act", basis, "consequential_action", session="s")
        for i in range(flagged):
            g.claim(p, f"f{i}", "vibes", "relational_drift", session="s")
    graph = g.graph(spark)
    assert [(r["project"], r["anchor_id"], r["measure"]) for r in D.sycophancy_saturation(graph).collect()] == [("sat", "sat.b2", 4)]
    assert {r["project"]: r["claim_ids"] for r in D.amplification_cascade(graph).collect() if r["project"] != "sat"} == {"run": "run.b0,run.b1,run.b2"}
    assert {p: r[0]["severity"] for p, r in by_project(D.consequential_action(graph)).items()} == {"crit": "critical", "warn": "warning", "info": "info"}
    drift = by_project(D.sentience_drift(graph))
    assert {p: {r["severity"] for r in rows} for p, rows in drift.items()} == {"run": {"info"}, "cut": {"warning"}}


def test_strengths_and_orphans(spark):
    g = Graphs()
    supported(g, "good", "a", 2, basis="empirical")
    g.claim("held", "p", "vibes", "challenged").claim("held", "x").claim("held", "y").edge("held", "x", "supports", "p").edge("held", "p", "supports", "y")
    g.claim("taken", "u", "research")
    for i in range(2):
        g.claim("taken", f"b{i}", speaker="assistant").edge("taken", f"b{i}", "depends_on", "u")
    g.claim("lone", "o").claim("lone", "self").edge("lone", "self", "supports", "self")
    graph = g.graph(spark)
    assert set(by_project(D.well_sourced_load_bearer(graph))) == {"good", "taken"}
    assert set(by_project(D.productive_stress_test(graph))) == {"held"}
    assert set(by_project(D.grounded_premise_adopted(graph))) == {"taken"}
    assert [r["anchor_id"] for r in D.orphan(graph).collect()] == ["lone.o"]


def test_empty(spark):
    graph = Graphs().graph(spark)
    assert D.findings(graph, ("load_bearing_vibes", "fluency_trap", "echo_chamber", "orphan", "amplification_cascade", "coverage_imbalance", "unchallenged_chain", "bottleneck")).count() == 0
