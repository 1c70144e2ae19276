"""Every operator on rows with null ids, clashing columns and repeated rows."""

import public_tokenizers
from pyspark.sql import functions as F

from claimloom.llm import chat_format, decontaminate, hilbert_packing, language_id, quality_knn, rabitq_dedup, secret_scan, simhash_vptree, warc_zstd

#: Names that operators use inside.
CLASHES = ("key", "fp", "head", "words", "spans", "base", "n_words", "place", "part", "tie", "score", "lang", "payload", "sha", "component_id", "size", "x", "rep",
           "bad", "bad_id", "bad_key", "kept", "kept_id", "all", "found", "span", "quality_score", "_quality_score", "row", "h", "at", "win", "freq", "hit_id", "turn_number", "tie", "formatted", "code", "first_sha", "refers_to", "a.b")


def crowded(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def test_documents(spark):
    rows = [(1, "alpha beta gamma delta epsilon token=abcdefgh1234"), (None, "alpha beta gamma delta epsilon"), (2, None), (2, None), (3, ""), (3, "other words under one id here")]
    docs = crowded(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = crowded(spark.createDataFrame([(None, "alpha beta gamma"), (7, None)], "item_id long, text string"))
    assert secret_scan.secret_spans(docs).count() == len(rows)
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.redact(docs).count() == len(rows)
    out = decontaminate.contamination(docs, bench).collect()
    assert len(out) == len(rows) and sum(r["n_hit"] for r in out) == 6
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert simhash_vptree.simhash_classes(docs).count() == len(rows)
    assert simhash_vptree.keep_one_of_each(docs).columns == docs.columns
    labels = crowded(spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int"))
    assert quality_knn.keep_good(docs, labels).columns == docs.columns
    assert docs.select(language_id.identify(docs, language_id.fit_from(docs))).count() == len(rows)
    pieces = hilbert_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), partitions=3)
    assert pieces.where("start = 0").count() == len(rows)


def test_other_tables(spark):
    vectors = crowded(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, None, None)], "vec_id long, embedding array<double>, label int"))
    got = {tuple(r) for r in rabitq_dedup.near_duplicates(vectors).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}
    pages = crowded(spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string"))
    assert wz_rows(pages) == {(1, "response"), (None, "response")}
    turns = crowded(spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    formatted = chat_format.format_turns(turns.withColumn("content", chat_format.text_part(F.col("text"))))
    assert {(r["conv_id"], r["n_turns"]) for r in chat_format.conversation_digests(formatted).collect()} == {(None, 1), (1, 1)}


def wz_rows(pages):
    return {(r["page_id"], r["record_type"]) for r in warc_zstd.read_archives(warc_zstd.archive_pages(pages)).collect()}
