"""Against a brute-force search of every window."""

import random
import re

from claimloom.llm import decontaminate as dc


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench, window=13):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, items = set(), set()
        for item_id, t in bench:
            b = words(t)
            n = min(len(b), window)
            if not n:
                continue
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    items.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, bench, **more):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, h int")
    b = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, doc_id int")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(r["item_ids"]), r["contaminated"]) for r in dc.contamination(d, b).collect()]
    assert sorted(got, key=str) == brute(docs, bench)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["the", "a", "Ünder", "x1", "of", "Zeta", "ñu", "𝒳y"] + ["w%d" % i for i in range(60)]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 9, 13, 20, 40])))) for i in range(12)]
    bench += [(90, "the " * 15), (91, bench[4][1]), (92, None), (93, "!!"), (94, " ".join(vocabulary[10:40]))]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            b = (rng.choice(bench)[1] or "").split()
            at, cut = rng.randint(0, len(w)), rng.randint(0, 5)
            w[at:at] = b[cut:]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "the " * 40), (5, docs[5][1]), (6, docs[7][1])]
    check(spark, docs, bench)


def test_drops_only_contaminated_rows(spark):
    bad, clean = " ".join("b%d" % i for i in range(20)), "clean words that no benchmark has"
    rows = [(None, bad), (None, clean), (None, None), (1, bad), (1, clean), (1, bad), (2, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, bad)], "item_id long, text string")
    got = [tuple(r) for r in dc.drop_contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] != bad], key=str)


def test_empty_tables(spark):
    check(spark, [(1, "some words here")], [])
    check(spark, [], [(1, "some words here")])


def test_clashing_names(spark):
    """Names that the operator uses inside are the caller's to use."""
    rows = [(1, "one two three four five six seven", *range(8)), (2, "clean words", *range(8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad int, bad_id int, key int, hit_id int, h int, at int, words int, n_hit int")
    bench = spark.createDataFrame([(1, "two three four", 0, 0)], "item_id long, text string, win int, len int")
    assert [r["doc_id"] for r in dc.drop_contaminated(docs, bench).collect()] == [2]
    assert dc.contamination(docs, bench).count() == 2


def test_blocks_find_the_same(spark):
    docs = spark.createDataFrame([(1, " ".join("w%d" % i for i in range(50)))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join("w%d" % i for i in range(10, 40)))], "item_id long, text string")
    rows = dc.window_hits(docs, dc.staged_benchmark(bench).windows, block_rows=3).collect()
    assert sorted(r["start"] for r in rows) == list(range(10, 28))


def test_items_of_a_shared_window_are_not_broadcast(spark):
    """A window of many items is one row of what is broadcast, and all of its items are found."""
    text = " ".join("w%d" % i for i in range(13))
    bench = spark.range(30_000).selectExpr("id as item_id", f"'{text}' as text")
    known = dc.staged_benchmark(bench)
    assert known.windows.columns == ["win", "words", "len", "win_id"] and known.windows.count() == 1
    docs = spark.createDataFrame([(1, text), (1, text), (2, "clean words"), (None, f"x {text} y")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_hit"], r["n_items"], len(set(r["item_ids"]))) for r in dc.contamination(docs, bench).collect())
    assert got == [(0, 13, 30_000, 30_000), (1, 13, 30_000, 30_000), (1, 13, 30_000, 30_000), (2, 0, 0, 0)]
