"""Batches, changes and streams on literal rows."""

import datetime as dt
import hashlib
import json
import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import detectors as D
from claimloom.operators import evaluation as E
from claimloom.operators import ingest as I
from claimloom.operators import maintenance as M
from claimloom.operators import scans as S
from claimloom.sources import transcripts
from claimloom.streaming import events as V
from tests.graphs import AS_OF, CLAIMS, EDGES, NOW, Graphs

EXTRACTED = "batch string, index long, text string, basis string, confidence double, source string, speaker string, depends_on array<long>, supports array<long>, contradicts array<long>, questions array<long>, depends_on_existing array<string>, supports_existing array<string>, contradicts_existing array<string>, questions_existing array<string>"


def extracted(spark, *rows):
    out = []
    for index, text, lists in rows:
        out.append(("b", index, text, "vibes", 0.5, None, "user", *[lists.get(k, []) for k in ("depends_on", "supports", "contradicts", "questions")], *[lists.get(f"{k}_existing") for k in ("depends_on", "supports", "contradicts", "questions")]))
    return spark.createDataFrame(out, EXTRACTED)


def test_ingest_batch(spark):
    g = Graphs().claim("p", "old", text="the harbour bridge carries freight trains daily", age_days=9).claim("p", "gone", "vibes", "archived", text="winter shipping lanes freeze over early", age_days=80)
    g.claim("q", "other", text="completely different statement about gardens", age_days=7)
    claims, edges = spark.createDataFrame(g.claims, CLAIMS), spark.createDataFrame(g.edges, EDGES)
    rows = extracted(
        spark,
        (0, "the harbour bridge carries freight trains daily", {"supports": [0, 1]}),
        (1, "winter shipping lanes freeze over early indeed", {"depends_on": [2, 7]}),
        (2, "completely different statement about gardens", {"contradicts": [0, 0], "questions_existing": ["p.old", "nowhere"]}),
    )
    none = spark.createDataFrame([], "session_id string, claim_id string")
    out, links, bridge = I.ingest_batch(claims, edges, none, rows, "p", AS_OF)
    new = I.batch_id(F.lit("b"), F.lit(2))
    new = spark.range(1).select(new).first()[0]
    got = {r["id"]: r for r in out.collect()}
    # like claims of the project are that claim, archived ones come back as of now; a like claim of another project is not
    assert set(got) == {"p.old", "p.gone", "q.other", new} and not got["p.gone"]["archived"] and got[new]["project"] == "p" and got[new]["turn_number"] == 0
    assert got["p.gone"]["last_referenced_at"] == NOW and got["q.other"]["last_referenced_at"] == NOW - dt.timedelta(days=7)
    # edges touch their ends, and what a newer claim contradicts is closed
    assert got["p.old"]["last_referenced_at"] == NOW and got["p.old"]["closed"] and not got[new]["closed"]
    assert {(r["from_id"], r["relation"], r["to_id"]) for r in links.collect()} == {("p.old", "supports", "p.gone"), ("p.gone", "depends_on", new), (new, "contradicts", "p.old"), (new, "questions", "p.old")}
    # a claim that wasn't archived stays in its own sessions, but a document's session holds all that it says
    assert {(r["session_id"], r["claim_id"]) for r in bridge.collect()} == {("b", "p.gone"), ("b", new)}
    document = I.ingest_batch(claims, edges, none, rows, "p", AS_OF, documents=True)
    assert {r["claim_id"] for r in document.bridge.collect()} == {"p.old", "p.gone", new}


def test_ingest_checks_deduplicates_prunes_and_sweeps(spark):
    g = Graphs()
    for i in range(7):
        g.claim("p", f"n{i}", "research", text=f"{i}{i}{i}{i}", age_days=40, idle_days=1)
    g.claim("p", "stale", text="nobody looks at this any more", age_days=50).claim("p", "hidden", "vibes", "archived", text="9999", age_days=50)
    for i in range(1, 6):
        g.edge("p", "n0", "supports", f"n{i}", strength=0.5 + i / 10)
    g.edge("p", "n0", "supports", "hidden")
    claims, edges = spark.createDataFrame(g.claims, CLAIMS), spark.createDataFrame(g.edges, EDGES)
    say = lambda i, text, basis, source, lists: ("b", i, text, basis, 0.5, source, "user", *[lists.get(k) for k in ("depends_on", "supports", "contradicts", "questions", "depends_on_existing", "supports_existing", "contradicts_existing", "questions_existing")])
    rows = [
        say(1, "Rivers carry sediment to the sea each spring", "research", "Nobody (1999)", {"supports": [3]}),
        say(2, "Rivers carry sediment to the sea each spring season", "vibes", None, {"contradicts_existing": ["p.n6"], "depends_on": [1, 3]}),
        say(3, "Harvests depend upon the moon entirely", "research", "The Almanac of 1812", {}),
        say(4, "0000", "vibes", None, {"contradicts_existing": ["p.n6"]}),
        say(4, "0000", "vibes", None, {"contradicts_existing": ["p.n6"]}),
    ]
    told = spark.createDataFrame([("b", "they read the almanac aloud")], "batch string, transcript string")
    out, links, bridge = I.ingest_batch(claims, edges, spark.createDataFrame([], "session_id string, claim_id string"), spark.createDataFrame(rows, EXTRACTED), "p", AS_OF, transcripts=told, sweep_cap=0)
    got = {r["id"]: r for r in out.collect()}
    made = {r["text"]: r for r in got.values() if not r["id"].startswith("p.")}
    # two wordings are one claim; research that the transcript doesn't know gives way, research that it knows stays
    assert {t: (r["basis"], r["source"]) for t, r in made.items()} == {"Rivers carry sediment to the sea each spring season": ("llm_output", ""), "Harvests depend upon the moon entirely": ("research", "The Almanac of 1812")}
    rivers, moon = made["Rivers carry sediment to the sea each spring season"]["id"], made["Harvests depend upon the moon entirely"]["id"]
    edges_of = lambda x: {(r["relation"], r["to_id"]) for r in links.collect() if r["from_id"] == x}
    assert edges_of(rivers) == {("supports", moon), ("depends_on", moon), ("contradicts", "p.n6")}
    # the row of index 4, said twice, is the claim that says the same
    assert len(got) == len(g.claims) + 2
    # five outgoing edges stay, the contradiction before all; an edge to an archived claim doesn't count and stays
    assert got["p.stale"]["archived"] and not got["p.n1"]["archived"] and got["p.n6"]["closed"]
    assert len(edges_of("p.n0")) == 6 and ("supports", "p.hidden") in edges_of("p.n0")
    assert {r["claim_id"] for r in bridge.collect()} >= {rivers, moon}


def test_insert_takes_each_id_once(spark):
    claims = spark.createDataFrame(Graphs().claim("p", "a").claims, CLAIMS)
    new = [("", "same", "s", None), (None, "same", "s", None), ("x", "one", "s", "given"), ("x", "two", "s", "given"), ("p.a", "there", "s", "p")]
    out = I.insert_claims(claims, spark.createDataFrame(new, "id string, text string, session_id string, project string").selectExpr("*", "cast(null as timestamp_ntz) as created_at", "cast(null as timestamp_ntz) as last_referenced_at", "1 as row", "'x' as marked"), "p", AS_OF)
    rows = out.collect()
    assert len(rows) == 3 and sorted(r["text"] for r in rows) == ["claim a", "one", "same"]


def test_changes_keep_clashing_names(spark):
    """Columns named like those that a change needs inside are the caller's."""
    claims = spark.createDataFrame(Graphs().claim("p", "a").claim("p", "b").claims, CLAIMS).selectExpr("*", "1 as marked", "2 as marked_", "'t' as new_text", "3 as _hit", "4 as place")
    ids = claims.where("id = 'p.a'").select("id")
    edges = spark.createDataFrame(Graphs().edge("p", "a", "contradicts", "b").edges, EDGES).withColumn("place", F.lit(7))
    for out in (M.set_archived(claims, ids, True), M.close_claims(claims, ids), M.challenge(claims, claims.selectExpr("id", "'n' as new_text", "'' as new_basis")), M.close_superseded(claims, edges)):
        assert out.columns == claims.columns and out.count() == 2 and {(r["marked"], r["marked_"], r["new_text"], r["place"]) for r in out.collect()} == {(1, 2, "t", 4)}
    assert [r["place"] for r in M.prune_edges(edges).collect()] == [7]


def test_resolution_is_per_project(spark):
    g = Graphs().claim("p", "a", text="Alpha beta", age_days=3).claim("p", "b", text="gamma alpha beta delta", age_days=2).claim("q", "c", text="only there", age_days=2).claim("p", "d", "vibes", "archived", text="only archived", age_days=1).claim("p", "x", text="xy", age_days=1)
    probes = [("p", None, " alpha BETA "), ("p", "p.a", "alpha beta"), ("p", None, "mma alp"), ("p", None, "only there"), ("p", None, "only archived"), ("p", None, "pha"), ("p", None, "xy"), ("p", None, " ")]
    out = S.resolve_text(spark.createDataFrame(probes, "project string, from_id string, needle string"), spark.createDataFrame(g.claims, CLAIMS)).collect()
    assert {(r["from_id"], r["needle"]): r["claim_id"] for r in out} == {
        (None, " alpha BETA "): "p.a", ("p.a", "alpha beta"): None, (None, "mma alp"): "p.b", (None, "only there"): None, (None, "only archived"): None, (None, "pha"): None, (None, "xy"): "p.x",
    }


def test_edges_between_projects_are_not_active(spark):
    g = Graphs().claim("p", "a").claim("q", "b").claim("p", "c")
    g.edges.append(("e", "p.a", "q.b", "supports", 1.0, NOW))
    assert [r["id"] for r in g.edge("p", "a", "supports", "c").graph(spark).edges.collect()] == ["p.a-supports-c"]


def test_challenge_and_merge(spark):
    g = Graphs().claim("p", "a").claim("p", "b").claim("p", "c").claim("p", "d")
    g.edge("p", "a", "supports", "d").edge("p", "b", "supports", "d").edge("p", "a", "supports", "b")
    claims, edges = spark.createDataFrame(g.claims, CLAIMS), spark.createDataFrame(g.edges, EDGES)
    changes = spark.createDataFrame([("p.a", None, None), ("p.b", "new", None), ("p.b", "", "research")], "id string, new_text string, new_basis string")
    out = {r["id"]: (r["challenged"], r["text"], r["basis"]) for r in M.challenge(claims, changes).collect()}
    assert len(out) == 4 and out["p.a"] == (True, "claim a", "vibes") and out["p.b"] == (True, "new", "research") and not out["p.c"][0]
    left, links = M.merge_claims(claims, edges, spark.createDataFrame([("p.a", "p.b"), ("p.b", "p.c")], "absorb string, keep string"))
    assert {r["id"] for r in left.collect()} == {"p.c", "p.d"}
    assert {(r["from_id"], r["to_id"]) for r in links.collect()} == {("p.c", "p.d")}
    with pytest.raises(ValueError, match="circle"):
        M.settled_merges(spark.createDataFrame([("a", "b"), ("b", "a")], "absorb string, keep string"))


def test_findings_are_those_of_all_detectors(spark):
    g = Graphs()
    for i in range(9):
        g.claim("p", f"n{i}", "vibes" if i % 2 else "research", session=f"s{i % 2}", turn=i, speaker="assistant" if i % 3 else "user", age_days=0)
    for i in range(8):
        g.edge("p", f"n{i}", "depends_on", f"n{i + 1}")
    graph = g.claim("p", "alone").graph(spark)
    key = lambda r: (r["type"], r["severity"], r["anchor_id"] or "", r["claim_ids"] or "", r["persistent"], r["measure"])
    got = sorted(map(key, D.findings(graph).collect()))
    assert got == sorted(key(r) for f in D.DETECTORS.values() for r in f(graph).collect())
    assert {"unchallenged_chain", "orphan"} <= {k[0] for k in got}


def test_verify_texts(spark):
    texts = ["Café  au\tlait", "CAFÉ AU LAIT", "ẞtraße", "é" * 150, "a" * 199 + "é", "", " x ", "😀" * 60]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.verify_key(F.col("t")), T.query_text(F.col("t"))).collect()
    for t, key, query in rows:
        folded = " ".join(unicodedata.normalize("NFC", t).casefold().split())
        assert key == hashlib.sha256(folded.encode()).hexdigest()[:24]
        bare = " ".join(t.split()).encode()
        assert query == bare[:200].decode(errors="ignore")
    assert rows[0][1] == rows[1][1]


def test_readers(spark, tmp_path):
    (tmp_path / "maps").mkdir()
    nodes = [{"nodeID": str(i), "type": k, "text": f"t{i}"} for i, k in enumerate(["I", "RA", "I", "CA", "I", "L"])]
    edges = [{"fromID": a, "toID": b} for a, b in (("0", "1"), ("1", "2"), ("4", "3"), ("3", "0"), ("5", "0"))]
    (tmp_path / "maps" / "a.json").write_text(json.dumps({"nodes": nodes, "edges": edges}, indent=1))
    said, links = transcripts.argument_maps(spark, str(tmp_path / "maps"))
    assert {r["id"] for r in said.collect()} == {"0", "2", "4"}
    assert {(r["from_id"], r["relation"], r["to_id"]) for r in links.collect()} == {("0", "supports", "2"), ("4", "contradicts", "0")}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "s.md").write_text("short é")
    (tmp_path / "docs" / "l.md").write_text("long " * 100)
    assert {(r["text"], r["too_long"]) for r in transcripts.read_documents(spark, str(tmp_path / "docs"), most=50).collect()} == {("short é", False), (None, True)}
    (tmp_path / "t.jsonl").write_text('{"role": "user", "content": "a"}\nbad\n{"message": {"role": "assistant", "content": "b"}}\n')
    turns = transcripts.parse_lines(transcripts.read_transcripts(spark, str(tmp_path / "t.jsonl")), ["path"])
    assert [(r["turn"], r["text"]) for r in turns.orderBy("turn").collect()] == [(1, "a"), (2, "b")]
    assert [(r["role"], r["text"]) for r in transcripts.recent_messages(spark, str(tmp_path / "t.jsonl"), most=1).collect()] == [("assistant", "b")]
    assert [(r["role"], r["text"]) for r in transcripts.recent_messages(spark, str(tmp_path / "t.jsonl"), tail=70).collect()] == [("assistant", "b")]


def test_match_rates(spark):
    rows = spark.createDataFrame([(10, 7, 4, 2, 5, 1), (0, 0, 1, 1, 5, 1)], "gold_claims long, matched_claims long, gold_edges long, matched_edges long, found_edges long, right_relations long")
    assert tuple(E.match_rates(rows).first()) == (0.7, 3 / 5, 3 / 10, 2 / 3)
    assert tuple(E.match_rates(rows.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)


def hours(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def lines_of(rows):
    return "".join(json.dumps({"claim_id": c, "type": "t", "fired_at": at.isoformat(), "persistent": p}) + "\n" for c, at, p in rows) + "not json\n"


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    """One file a micro-batch; a late row is dropped once the watermark has passed it, and state goes when its rest is over."""
    schema = "claim_id string, type string, fired_at timestamp, persistent boolean"
    batches = [[("a", hours(0), False), ("a", hours(1), False), ("b", hours(2), True)], [("a", hours(25), False), ("b", hours(26), True)], [("a", hours(49), False)], [("c", hours(500), False), ("b", hours(3), True)], [("b", hours(501), True)]]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.jsonl").write_text(lines_of(rows))
        os.utime(folder / f"{i}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    on_time = [r for rows in batches for r in rows if r[1] != hours(3)]
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).select(F.from_json("value", schema).alias("e")).where("e.claim_id is not null").select("e.*")
    got = {tuple(r) for r in V.run_to_table(V.cooldown(lines), "cooldown-test").collect()}
    batch = spark.createDataFrame([(c, "t", at, p) for c, at, p in on_time], schema)
    assert got == {tuple(r) for r in V.cooldown(batch).collect()}
    assert {(r[0], r[2]) for r in got if r[3]} == {("a", hours(0)), ("a", hours(25)), ("a", hours(49)), ("b", hours(2)), ("c", hours(500)), ("b", hours(501))}


def test_line_stream_and_duplicates(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("a", hours(0), True), ("a", hours(0.05), True), ("b", hours(1), False)]
    (folder / "x.jsonl").write_text(lines_of(rows))
    stream = V.line_stream(spark, str(folder), "claim_id string, type string, fired_at timestamp, persistent boolean").withColumnRenamed("fired_at", "ts")
    out = V.run_to_table(V.first_of_key(stream, ["claim_id", "type"]).select("claim_id", "type"), "lines-test")
    assert sorted(map(tuple, out.collect())) == [("a", "t"), ("b", "t")]
