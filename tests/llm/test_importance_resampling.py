import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from claimloom.llm import features
from claimloom.llm import importance_resampling as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(text, buckets=10_000):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def random_text(r, n):
    return "".join(r.choice(["a", "B", "z", "9", " ", "-", "é", "É", "日本", "x" * 50, "\n", "foo", "Q" * 90]) for _ in range(n))


def test_features_of_blocks_equal_joined_words(monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(features, "AT_ONCE", 700)
    texts = [random_text(r, r.randint(0, 60)) for _ in range(600)] + ["", None, "a", "b", " ", "the end", "x" * 3000]
    for column in (pa.array(texts), pa.array(texts).slice(7), pa.array([], pa.string()), pa.array([None, None], pa.string())):
        got = {}
        for row, data, ends in features.text_blocks(column):
            text, bucket, words = op.features(data, ends)
            for i in range(len(ends)):
                got[row + i] = (sorted(bucket[text == i].tolist()), int(words[i]))
        want = [plain(t) for t in column.to_pylist()]
        assert got == {i: (sorted(b), len(w)) for i, (w, b) in enumerate(want)}


def brute(docs, bench, percent=5):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain(text)[1])
    for _, text in bench:
        t.update(plain(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for doc_id, text in docs:
        words, buckets = plain(text)
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= 20))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter((r[0], r[3], i + 1) for i, r in enumerate(order[: len(order) * percent // 100]))
    return out, drawn


def test_equals_brute_force_with_nulls_ties_repeats_and_clashes(spark):
    r = random.Random(8)
    docs = [(i, random_text(r, r.randint(0, 120))) for i in range(300)]
    docs += [(i, docs[0][1]) for i in range(400, 420)] + [(7, "same words " * 30)] * 40 + [(None, "no id " * 30)] * 3 + [(900, None), (901, "")]
    bench = [(1, "same words of the bench"), (2, None), (3, random_text(r, 200))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as rank", "true as eligible", "2 as place", "3 as `range`")
    # at 95 of 100 the repeated rows, which tie, and rows without an id are drawn too
    for percent in (5, 95):
        got = op.resampled(frame.repartition(5), spark.createDataFrame(bench, "item_id long, text string"), (percent, 100)).collect()
        want, drawn = brute(docs, bench, percent)
        assert Counter((g.doc_id, g.n_features, g.weight, g.score) for g in got) == Counter(w[:4] for w in want)
        assert Counter((g.doc_id, g.score, g["rank"]) for g in got if g["rank"] is not None) == drawn
        assert percent == 5 or {7, None} < {d[0] for d in drawn}


def test_no_target_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert op.resampled(none, none).count() == 0
    got = {r.doc_id: r for r in op.resampled(docs, none).collect()}
    want, _ = brute([(1, "a b"), (2, None)], [])
    assert [tuple(got[w[0]])[:4] for w in want] == [w[:4] for w in want] and got[2].n_features == 0 and got[1]["rank"] is None


def test_gain_is_one_vector_a_task(spark):
    docs = spark.createDataFrame([(i, f"w{i % 50} w{i % 7} common") for i in range(500)], "doc_id long, text string").repartition(7)
    counts = op.bucket_counts(docs, buckets=64)
    want = np.zeros(64, np.int64)
    for i in range(500):
        for b in plain(f"w{i % 50} w{i % 7} common", 64)[1]:
            want[b] += 1
    assert counts.tolist() == want.tolist()
