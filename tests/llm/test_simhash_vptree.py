"""Fingerprints against a plain version, classes against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from claimloom.llm import simhash_vptree as sv


def plain_simhash(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius=4):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_plain():
    for text in [None, "", " \t\n", "one", "One two three", "a b c d", "A b\x0bc d e É é", "x " * 3000, "\x1ca b c d e f"]:
        assert sv.simhash(text) == plain_simhash(text), text


def test_classes_with_small_shards(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(250)]
    near = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 6))) for b in base for _ in range(2)]
    hot = [base[0] ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)]
    prints = sorted(set(base + near + hot))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = sv.links(spark.createDataFrame([(x,) for x in signed], "fp long"), shard_rows=40)
    want = plain_classes(dict(enumerate(prints)))
    got = {x: x for x in signed}
    from claimloom.plans.components import connected_components

    got |= {r["node"]: r["component"] for r in connected_components(links).collect()}
    groups, wanted = {}, {}
    for i, x in enumerate(signed):
        groups.setdefault(got[x], set()).add(i)
        wanted.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_tree_search_finds_every_near_pair():
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(150)]
    spread = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) for b in base for _ in range(3)]
    one_value = [(rng.getrandbits(48) << 16) | 0xBEEF for _ in range(120)]
    one_value += [x ^ (1 << rng.randrange(16, 64)) ^ (1 << rng.randrange(16, 64)) for x in one_value]
    dense = [sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(200)]
    for some in (spread, one_value, dense, spread + one_value + dense, [5], []):
        fps = np.array(sorted(set(some)), np.uint64)
        found = set()
        for block in range(sv.BLOCKS):
            for i, j in sv.near_pairs(fps, block, 4, leaf=8):
                found |= set(zip(i.tolist(), j.tolist()))
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
        assert found == want


def test_documents(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(30)]
    texts += [t + " tail" for t in texts[:10]] + texts[:5] + [None, "", "  ", "Word", "word"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = sv.simhash_classes(docs).collect()
    assert len(out) == len(rows)
    prints = {i: plain_simhash(t) for i, t, _ in rows}
    want = plain_classes(prints)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in out} == prints
    kept = sv.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([i for i, _, _ in rows if want[i] == i])


def test_one_of_each_without_ids(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(rng.choices(["w%d" % i for i in range(300)], k=120)) for _ in range(4))
    # a: numbered and not; b: no ids at all, from two sources; c: under the kept id 1 too, but its class has 0; d: alone under id 1
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (None, b, "t"), (1, c, "s"), (0, c, "s"), (None, c, "s"), (1, d, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in sv.keep_one_of_each(docs).collect()]
    assert len(got) == 4 and {r[:2] for r in got} == {(1, a), (None, b), (0, c), (1, d)}
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in sv.keep_one_of_each(docs.orderBy("source", "text")).collect())
    twice = sv.keep_one_of_each(docs.where("doc_id = 1").union(docs.where("doc_id = 1"))).collect()
    assert sorted(r["text"] for r in twice) == sorted([a, a, c, c, d, d])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sv.simhash_classes(docs).count() == 0
    assert docs.select(F.lit(1)).count() == 0
