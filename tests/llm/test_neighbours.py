import math

import numpy as np
from pyspark.sql import functions as F

from meltframe.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1) for i, v in rows], SCHEMA)


def brute(rows, k):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q in sorted({i for i, _ in kept if i % 100 == 0}):
        x = min((v.tolist() for i, v in kept if i == q), key=lambda v: v)
        near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in kept if i != q and len(v) == len(x))[:k]
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    return out


def check(spark, rows, k=10):
    got = sorted(map(tuple, N.nearest(table(spark, rows), F.col("vec_id") % 100 == 0, k).collect()))
    want = brute(rows, k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12, abs_tol=1e-12) for g, w in zip(got, want))


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "CANDIDATES_PER_BLOCK", 90)
    monkeypatch.setattr(N, "QUERIES_PER_BLOCK", 4)
    monkeypatch.setattr(N, "GROUPS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=16) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(1_200)]
    # a third of the table is one vector, in ties that only the ids break
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    check(spark, rows)


def test_odd_vectors(spark):
    rows = [(0, [1, 2, 3]), (1, [1, 2, 3.5]), (2, None), (3, []), (4, [0, 0, 0]), (5, [1, None, 2]), (6, [1, float("nan"), 2]), (7, [1, float("inf"), 2]),
            (None, [1, 2, 3]), (100, [1, 2]), (8, [1, 2]), (9, [-1, 2]), (9, [-1, 2]), (200, [9, 9, 9]), (200, [1, 1, 1]), (300, [0, 0, 0]), (400, [5.0]),
            (10, [1e-40, 0, 0]), (11, [3e38, -3e38, 3e38])]
    check(spark, rows)


def test_few_candidates_and_none(spark):
    check(spark, [(0, [1, 1])])
    check(spark, [(0, [1, 1]), (100, [1, 2]), (1, [1, 3])])
    check(spark, [])
    check(spark, [(1, [1, 2])])


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for scale in (1e-30, 1.0, 1e15):
        x, y = rng.normal(size=(50, 64)) * scale, rng.normal(size=(70, 64)) * scale
        y[:10] = x[:10] * (1 + 1e-9)

        def block(v):
            rounded, s, e = N.quantise(v)
            return N.Block({"dim": 64, "n": len(v), "ids": np.arange(len(v)).tobytes(), "vectors": v.tobytes(), "rounded": rounded.tobytes(),
                            "scale": s.tobytes(), "residue": e.tobytes()}, "")

        low, high = N.bounds(block(x), block(y), slice(0, 50))
        true = np.sqrt(((x[:, None] - y) ** 2).sum(axis=2))
        assert (low <= true).all() and (true <= high).all() and np.median((high - low) / true) < 0.1
