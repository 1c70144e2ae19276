"""Matching and evaluation against plain loops."""

import random
import re

from claimloom.operators import evaluation as E
from claimloom.operators import matching as X

VOCABULARY = "the river bridge carries trains café daily over old stones and new iron rails in winter".split()


def words(text):
    return set(re.findall(r"\w+", text.lower()))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def sentence(r):
    return "  ".join(r.choice(VOCABULARY) for _ in range(r.randint(0, 9)))


def episodes(seed, n, most):
    r = random.Random(seed)
    out = {}
    for e in range(n):
        gold = [(i, sentence(r)) for i in range(r.randint(0, most))]
        found = [(i, r.choice(gold)[1] + r.choice(["", " extra", " Old, stones!"]) if gold and r.random() < 0.7 else sentence(r)) for i in range(r.randint(0, most))]
        link = lambda n, i: (i, r.randrange(n), r.randrange(n + 1), r.choice(["supports", "depends_on", "contradicts", "questions"]))
        relations = [link(len(gold), i) for i in range(r.randint(0, 8))] if gold else []
        edges = [link(len(found), i) for i in range(r.randint(0, 12))] if found else []
        out[f"e{e}"] = (gold, relations, found, edges)
    return out


def plain_evaluation(gold, relations, found, edges, least=0.25):
    matches, used = {}, set()
    for i, text in gold:
        best, score = None, 0
        for j, other in found:
            s = jaccard(words(text), words(other))
            if s > score:
                best, score = j, s
        if score >= least and best is not None and best not in used:
            matches[i] = best
            used.add(best)
    known, taken, hits, right = {j for j, _ in found}, set(), 0, 0
    inner = [e for e in edges if e[1] in known and e[2] in known]
    for _, a, b, relation in relations:
        if a in matches and b in matches:
            for k, (_, x, y, got) in enumerate(inner):
                if k not in taken and (x, y) in ((matches[a], matches[b]), (matches[b], matches[a])):
                    taken.add(k)
                    hits += 1
                    right += (relation == "supports") == (got in ("supports", "depends_on"))
                    break
    return len(gold), len(matches), len(relations), hits, len(inner), right


def frames(spark, data):
    rows = [[], [], [], []]
    for e, parts in data.items():
        for out, part in zip(rows, parts):
            out += [(e, *x) for x in part]
    claims, edges = "episode string, place long, text string", "episode string, place long, from_place long, to_place long, relation string"
    return [spark.createDataFrame(r, s) for r, s in zip(rows, (claims, edges, claims, edges))]


def test_evaluation_equals_a_plain_loop(spark):
    data = episodes(3, 40, 9)
    got = {r["episode"]: tuple(r)[1:] for r in X.episode_evaluation(*frames(spark, data)).collect()}
    want = {e: plain_evaluation(*parts) for e, parts in data.items()}
    assert got == {e: w for e, w in want.items() if any(w)}
    total = [sum(w[i] for w in want.values()) for i in range(6)]
    rates = E.match_rates(X.episode_evaluation(*frames(spark, data))).first()
    assert total[3] > 5 and tuple(rates) == (total[1] / total[0], total[3] / total[2], total[3] / total[4], total[5] / total[3])


def test_evaluation_of_nothing(spark):
    none = frames(spark, {})
    assert X.episode_evaluation(*none).count() == 0 and tuple(E.match_rates(X.episode_evaluation(*none)).first()) == (0.0, 0.0, 0.0, 0.0)
    assert X.basis_matches(*[f.selectExpr("*", "'x' as basis") for f in none[::2]]).count() == 0


def test_basis_matches_equal_a_plain_loop_however_many_rounds(spark):
    data = episodes(5, 12, 12)
    # one episode in which all want the same few: rounds alone would go on for long
    data["same"] = ([(i, "the old bridge") for i in range(30)], [], [(i, "the old bridge" + " x" * (i % 3)) for i in range(25)], [])
    want = {}
    for e, (gold, _, found, _) in data.items():
        used = set()
        for i, text in gold:
            best, score = None, 0
            for j, other in found:
                a, b = set(text.lower().split()), set(other.lower().split())
                s = len(a & b) / max(len(a | b), 1)
                if j not in used and s > score:
                    best, score = j, s
            if best is not None and score > 0.15:
                used.add(best)
                want[e, i] = f"b{best % 4}"
            else:
                want[e, i] = None
    gold, _, found, _ = frames(spark, data)
    matched = X.basis_matches(gold.selectExpr("*", "concat('b', place % 4) as basis"), found.selectExpr("*", "concat('b', place % 4) as basis"))
    rows = matched.collect()
    assert {(r["episode"], r["place"]): r["got"] for r in rows} == want and len(rows) == len(want)
    hit, right = sum(g is not None for g in want.values()), sum(g == f"b{i % 4}" for (_, i), g in want.items())
    assert tuple(X.basis_accuracy(matched).first()) == (len(want), hit, right, right / len(want), right / hit)


def test_greedy_takes_the_best_free_one(spark):
    rows = [("e", 1, 10, 0.9), ("e", 1, 11, 0.8), ("e", 2, 10, 0.95), ("e", 2, 11, 0.1), ("f", 1, 10, 0.3), ("f", 2, 10, 0.9)]
    for rounds in (0, 1, 6):
        got = X.greedy_matches(spark.createDataFrame(rows, "episode string, left long, right long, score double"), rounds).collect() if rounds else X._walked(spark.createDataFrame(rows, "episode string, left long, right long, score double")).collect()
        assert {(x["episode"], x["left"], x["right"]) for x in got} == {("e", 1, 10), ("e", 2, 11), ("f", 1, 10)}
