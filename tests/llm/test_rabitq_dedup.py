"""Links and components against all pairs in double precision."""

import numpy as np
import pytest

from claimloom.llm import rabitq_dedup as rd


def brute(rows, least=0.93):
    ids, n, root = [r[0] for r in rows], {}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def sound(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i in ids:
        n[i] = 0
    for p, (a, x, k) in enumerate(rows):
        for b, y, l in rows[:p]:
            if k is None or k != l or not sound(x) or not sound(y) or len(x) != len(y):
                continue
            u, v = np.array(x, float), np.array(y, float)
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least:
                n[a] += 1
                n[b] += 1
                s, t = find(a), find(b)
                root[max(s, t)] = min(s, t)
    return {i: (n[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("block_rows", [16, 1000])
def test_against_all_pairs(spark, block_rows):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 24))
    near = base[rng.integers(0, 12, 80)] + rng.standard_normal((80, 24)) * 0.36
    x = np.concatenate([base, near, base[:6], base[:3], np.repeat(base[:1], 30, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2) if i < 120 else 1) for i, v in enumerate(x)]
    k = len(rows)
    odd = [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0] * 8, [1.0] * 8]
    rows += [(k + i, v, 1) for i, v in enumerate(odd)] + [(k + 10, rows[0][1], None), (k + 11, [None] + [1.0] * 23, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rd.near_duplicates(df, block_rows=block_rows).collect()}
    assert got == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((400, 64)), rng.standard_normal((400, 64))
    codes, factors = rd.encode(x)
    signs = (np.unpackbits(codes, axis=1).astype(float) * 2 - 1) / 8
    ux, uy = rd._unit(x), rd._unit(y)
    estimate = (signs @ (uy @ rd.rotation(64)).T) / factors[:, None]
    error = estimate - ux @ uy.T
    assert abs(error.mean()) < 0.005 and error.std() < 0.12
    assert not rd.linked(y, x, codes, factors, 0.93, 6.0).any()


def test_empty(spark):
    assert rd.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
