"""Each stage against a plain version on a small corpus."""

import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute
from tests.llm.test_hilbert_packing import reference
from tests.llm.test_secret_scan import brute_base
from tests.llm.test_simhash_vptree import plain_classes, plain_simhash


def corpus():
    rng = random.Random(9)
    words = ["word%d" % i for i in range(400)]
    texts = [" ".join(rng.choices(words, k=90)) + "." for _ in range(60)]
    bench = [(i, " ".join(rng.choices(words, k=25))) for i in range(5)]
    texts += [t + " more" for t in texts[:8]] + texts[:5]
    texts += [" ".join(rng.choices(words, k=40)) + " " + b for _, b in bench]
    texts += [t + " password = hunter2hunter2" for t in texts[20:24]] + [None, ""]
    texts += ["!!! $$$ *** " * 30 + str(i) for i in range(12)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 0 if "$$$" in (t or "") else 1, 0) for i, t, *_ in rows if t]
    return rows, bench, labels


def test_stages(spark, tmp_path):
    rows, bench, labels = corpus()
    d = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now, columns = docs, docs.columns
    good = corpus_pipeline.quality(spark, now, d)
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns
    assert {i for i, t, *_ in rows if t and "$$$" not in t} <= kept
    assert not {i for i, t, *_ in rows if t and "$$$" in t} & kept

    one = corpus_pipeline.near_duplicates(spark, docs, d)
    classes = plain_classes({i: plain_simhash(t) for i, t, *_ in rows})
    assert one.columns == columns
    assert {r["doc_id"] for r in one.collect()} == {i for i in classes if classes[i] == i}

    clean = corpus_pipeline.decontaminated(spark, docs, d)
    bad = {r[0] for r in brute([r[:2] for r in rows], bench) if r[4]}
    assert bad and clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - bad

    masked = corpus_pipeline.secrets_masked(spark, docs, d)
    assert masked.columns == columns
    for r in masked.collect():
        before = rows[r["doc_id"]][1]
        assert r["text"] == before if not brute_base(before) else ("hunter2" not in r["text"] and r["n_chars"] == len(r["text"]))


def test_run_and_empty(spark, tmp_path):
    rows, bench, labels = corpus()
    for name, some in (("full", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert bool(out) == bool(some)
        # quality by the stage itself, then every stage's plain version on what is left
        docs = spark.read.parquet(f"{d}/documents.parquet")
        good = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality(spark, docs, d).collect()}
        classes = plain_classes({i: plain_simhash(t) for i, t in good.items()})
        one = {i: t for i, t in good.items() if classes[i] == i}
        clean = {r[0] for r in brute(list(one.items()), bench) if not r[4]}
        assert {p["doc_id"] for p in out} == clean
        packed_alike(out, {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets_masked(spark, docs.where(F.col("doc_id").isin(list(clean))), d).collect()})


def packed_alike(pieces, texts):
    """Every id of every text lies in exactly one piece, and sequences have no gap."""
    spans, sequences = {}, {}
    for p in pieces:
        ids = reference(texts[p["doc_id"]])
        part = ids[p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        spans.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(spans) == set(texts)
    for parts in [*spans.values(), *sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert all(sum(n for _, n in spans[i]) == len(reference(t)) for i, t in texts.items())
    assert all(sum(n for _, n in parts) <= 2048 for parts in sequences.values())


def test_ids_that_repeat(spark, tmp_path):
    """Texts under one id are judged each for itself by every stage."""
    d = str(tmp_path)
    rows, bench, labels = corpus()
    bad = " ".join(b for _, b in bench)
    odd = [(7, bad, "en", "s", 1), (7, rows[30][1] + " token = abcdefgh1234", "en", "s", 1), (None, None, None, None, None), (None, bad, "en", "s", 1)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("found", F.lit("x"))
    clean = corpus_pipeline.decontaminated(spark, docs, d)
    texts = {(r["doc_id"], r["text"]) for r in clean.collect()}
    assert clean.columns == docs.columns and (7, bad) not in texts and (None, bad) not in texts
    assert {(7, rows[7][1]), (7, odd[1][1]), (None, None)} <= texts
    masked = {(r["doc_id"], r["text"]) for r in corpus_pipeline.secrets_masked(spark, docs, d).collect()}
    assert (7, rows[30][1] + " [SECRET]") in masked and (7, rows[7][1]) in masked
