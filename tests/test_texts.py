"""Text functions, chunking, similarity, transcripts and triples."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import chunking, text
from claimloom.functions.claims import is_ephemeral
from claimloom.operators import evaluation, knowledge_base, similarity
from claimloom.sources import transcripts

STATUS = [
    ("All 12 unit tests in the suite pass", True), ("The build is now clean", True), ("Lint came back green", True), ("The tag was  pushed to origin", True),
    ("Smoke tests confirm the fix", True), ("The flow works end-to-end", True), ("CI is still running", True), ("The release cycle completed", True), ("A hook was installed", True),
    ("Contests surpass expectations", False), ("The cache loses writes under load", False), ("étests pass", True), ("Users trust the wrong signal", False), ("Specific numbers are running out", False),
]


def test_status(spark):
    df = spark.createDataFrame(STATUS, "text string, want boolean")
    assert [r for r in df.withColumn("got", is_ephemeral()).collect() if r["got"] != r["want"]] == []


def test_shapes(spark):
    row = spark.createDataFrame([("one two three",)], "t string")
    one = lambda c: row.select(c.alias("x")).first()["x"]
    assert one(text.cut_at_word(F.lit("alpha beta gamma"), 12)) == "alpha beta..."
    assert one(text.cut_at_word(F.lit("alphabetgamma"), 5)) == "alpha..."
    assert one(text.cut_at_word(F.lit("short"), 12)) == "short"
    assert one(text.quoted_text(F.lit('x "some text..." y'))) == "some text"
    assert one(text.quoted_text(F.lit('x "open'))) == "open"
    assert one(text.quoted_text(F.lit("none"))) == "none"
    assert one(text.safe_project(F.lit("/a/b c!/"))) == "bc" and one(text.safe_project(F.lit("/!!"))) == "default"
    assert one(text.document_source(F.lit("/x/y.md"), F.array(F.lit("A"), F.lit("B")))) == "y.md#A/B"


DOC = "# Title\n\nIntro here.\n\n## A\n\nFirst.\n\nSecond.\n\n```\n# not a heading\n```\n## References\n\nBook.\n\n### More\n\nOther.\n\n## B\n\nLast one.\n"


def test_chunks():
    got = chunking.chunks_of(DOC)
    assert got == [(["Title"], "Intro here."), (["Title", "A"], "First.\n\nSecond.\n\n```\n# not a heading\n```"), (["Title", "B"], "Last one.")]
    assert chunking.chunks_of("---\na: b\n---\n\nBody.") == [([], "Body.")]
    assert chunking.chunks_of("**Author:** X\n\n---\nBody.") == [([], "Body.")]
    assert chunking.chunks_of(None) == chunking.chunks_of(" \n ") == []
    para = ("Word " * 20).strip()
    assert [t for _, t in chunking.chunks_of("\n\n".join([para] * 4), 210)] == [f"{para}\n\n{para}"] * 2
    long = " ".join(f"Sentence number {i} is here." for i in range(20))
    parts = [t for _, t in chunking.chunks_of(long, 100)]
    assert " ".join(parts) == long and all(len(p) <= 100 for p in parts)
    assert [t for _, t in chunking.chunks_of("x" * 300 + ". Short.", 100)] == ["x" * 300 + ".", "Short."]
    assert chunking.chunks_of("## Deep\n\ntext") == [(["", "Deep"], "text")]


def test_batch_dedup(spark):
    base = "the quick brown foxes jumped over several lazy sleeping dogs"
    rows = [
        (1, base, "vibes", "", "user", [5], [], [], []),
        (2, base + " again today", "research", "paper", "user", [], [1], [], [4]),
        (3, base, "vibes", "", "assistant", [2], [], [], []),
        (4, "completely different statement about weather patterns", "analogy", "", "user", [], [], [5], []),
        (5, "completely different statement about weather pattern", "vibes", "", "user", [], [], [], []),
        (6, "tiny", "vibes", "", "user", [6, 2], [], [], []),
    ]
    kinds = "index long, text string, basis string, source string, speaker string, depends_on array<long>, supports array<long>, contradicts array<long>, questions array<long>"
    got = {r["index"]: r for r in similarity.deduplicate_batch(spark.createDataFrame(rows, kinds)).collect()}
    assert set(got) == {2, 3, 4, 5, 6}
    assert got[2]["basis"] == "research" and got[2]["depends_on"] == [5] and got[2]["questions"] == [4] and got[2]["supports"] == []
    assert got[3]["depends_on"] == [2] and got[6]["depends_on"] == [2] and got[4]["contradicts"] == [5]


def test_transcript_lines(spark):
    lines = ['{"role":"user","content":"Hi"}', "not json", '{"message":{"role":"assistant","content":[{"type":"text","text":"A"},{"type":"image"},{"type":"text","text":"B"}]}}', '{"role":"system","content":"no"}', '{"role":"user","content":""}']
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(lines)], "path string, line_no long, value string")
    got = [(r["turn"], r["role"], r["text"]) for r in transcripts.parse_lines(df, ["path"]).orderBy("turn").collect()]
    assert got == [(1, "user", "Hi"), (2, "assistant", "A\nB"), (3, "user", "")]


@pytest.mark.parametrize("wrapped", [True, False])
def test_kb_file(spark, tmp_path, wrapped):
    claims = [{"var_name": f"k{i}", "predicate": p, "subject": s, "object": o, "prov_ref": r} for i, (p, s, o, r) in enumerate([("Supports", "X", "Y", "r1"), ("Disputes", "X", "Z", ""), ("Accepts", "X", "X", "gone"), ("Accepts", "", "X", "")])]
    data = {"claims": claims, "provenance": [{"var_name": "r1", "origin": "http://o", "quote": "q"}]} if wrapped else claims
    (tmp_path / "kb.json").write_text("﻿" + json.dumps(data), encoding="utf-8")
    found, records = transcripts.read_kb(spark, str(tmp_path / "kb.json"))
    triples = knowledge_base.with_provenance(found, records)
    got = {r["id"]: r for r in knowledge_base.kb_claims(triples).collect()}
    assert set(got) == {"k0", "k1", "k2"} and got["k1"]["basis"] == "assumption" and got["k2"]["confidence"] == 0.8
    assert got["k0"]["source"] == ("http://o" if wrapped else "")
    assert {(e["from_id"], e["to_id"], e["relation"]) for e in knowledge_base.kb_edges(triples).collect()} == {("k0", "k1", "contradicts"), ("k1", "k2", "contradicts")}


def test_gates(spark):
    cells = spark.createDataFrame([("pos", 0.9), ("neg", 0.4)], "cell string, rate double")
    r = evaluation.delivery_gate(cells).first()
    assert r["valid"] and r["neg_note"] and not r["neg_long_note"]
    assert evaluation.delivery_gate(cells.where("cell = 'neg'")).first()["reason"] == "missing pos"
    cases = [(5, 30, 0.9, 0.1, "pos_small_n"), (30, 5, 0.9, 0.1, "neg_small_n"), (30, 30, 0.69, 0.1, "pos_low"), (30, 30, 0.7, 0.31, "neg_high"), (30, 30, 0.7, 0.3, "valid")]
    df = spark.createDataFrame(cases, "a int, b int, c double, d double, want string")
    assert df.where(evaluation.validity(F.col("a"), F.col("b"), F.col("c"), F.col("d")) != F.col("want")).count() == 0
