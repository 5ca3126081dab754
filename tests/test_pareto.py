import numpy as np
import pytest
from pyspark.sql import functions as F

from meltframe.operators import pareto

OBJ = ["o1", "o2", "o3"]


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)],
                                 "id long, o1 double, o2 double, o3 double").repartition(5)


def brute(rows):
    rows = np.asarray(rows, dtype=float)
    return {
        i for i, r in enumerate(rows) if not any((q <= r).all() and (q < r).any() for q in rows)
    }


def brute_ranks(rows, top):
    rows, ranks, left, rank = np.asarray(rows, dtype=float), {}, list(range(len(rows))), 1
    while left and rank <= top:
        front = {left[i] for i in brute(rows[left])}
        ranks |= {i: rank for i in front}
        left = [i for i in left if i not in front]
        rank += 1
    return ranks


SETS = {
    "spread": lambda g: g.random((400, 3)),
    "ties": lambda g: g.integers(0, 6, (500, 3)),
    # a third of the rows are copies of one vector on the front
    "copies": lambda g: np.vstack([g.integers(1, 30, (200, 3)), np.zeros((100, 3))]),
    # nothing dominates anything
    "plane": lambda g: (lambda a: np.column_stack([a, 10 - a.sum(axis=1)]))(g.random((300, 2))),
}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("options", [{}, {"block_rows": 16, "window": 4}])
def test_front_matches_brute_force(spark, name, options):
    rows = SETS[name](np.random.default_rng(7))
    front = pareto.pareto_front(frame(spark, rows), OBJ, **options)
    assert {r["id"] for r in front.collect()} == brute(rows)


def test_front_of_the_front_is_the_front(spark):
    rows = np.random.default_rng(3).random((200, 3))
    front = pareto.pareto_front(frame(spark, rows), OBJ)
    again = pareto.pareto_front(front, OBJ)
    assert {r["id"] for r in again.collect()} == {r["id"] for r in front.collect()}


def test_infeasible_and_missing_rows_stay_out(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0, False), (2, 1.0, 1.0, 1.0, True), (3, 2.0, 2.0, 2.0, True), (4, None, 0.0, 0.0, True)],
        "id long, o1 double, o2 double, o3 double, ok boolean")
    assert [r["id"] for r in pareto.pareto_front(df, OBJ, feasible="ok").collect()] == [2]
    assert pareto.pareto_front(df.where("false"), OBJ, feasible="ok").count() == 0


def test_ranks_and_crowding_match_brute_force(spark):
    rows = np.random.default_rng(11).integers(0, 12, (150, 3))
    df = frame(spark, rows)
    ranked = pareto.pareto_rank(df, OBJ, max_rank=3)
    got = {r["id"]: r["pareto_rank"] for r in ranked.collect()}
    expected = brute_ranks(rows, 3)
    assert got == {i: expected.get(i) for i in range(len(rows))}
    everyone = {r["id"]: r["pareto_rank"] for r in pareto.pareto_rank(df, OBJ, cell_rows=16).collect()}
    assert everyone == brute_ranks(rows, len(rows))
    for bucket_values in (20_000, 3):
        crowd = {r["id"]: r["crowding"] for r in pareto.crowding_distance(ranked, OBJ, bucket_values=bucket_values).collect()}
        assert set(crowd) == set(range(len(rows)))
        assert all(crowd[i] is None for i in crowd if i not in expected)
        for rank in (1, 2, 3):
            ids = [i for i, k in expected.items() if k == rank]
            total = {i: 0.0 for i in ids}
            for j in range(3):
                line = sorted(ids, key=lambda i: (rows[i][j], i))
                span = rows[line[-1]][j] - rows[line[0]][j]
                total[line[0]] = total[line[-1]] = None
                for a, b, c in zip(line, line[1:], line[2:]):
                    if total[b] is not None:
                        total[b] += (rows[c][j] - rows[a][j]) / span if span else 0.0
            for i in ids:
                assert crowd[i] == (None if total[i] is None else pytest.approx(total[i] / 3))


def test_front_is_found_without_nested_loop_joins(spark):
    df = frame(spark, np.random.default_rng(1).random((50, 3)))
    plan = pareto.pareto_front(df, OBJ)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranks_of_chains_ties_and_infinities(spark):
    """A chain has as many fronts as rows; a constant and a 0/1 objective cannot be cut into strips."""
    n = 200
    rows = np.array([(i, i, 0.0) for i in range(n)] + [(i % 2, float("inf") if i % 3 else -float("inf"), 1.0) for i in range(60)])
    got = {r["id"]: r["pareto_rank"] for r in pareto.pareto_rank(frame(spark, rows), OBJ, cell_rows=20).collect()}
    assert got == brute_ranks(rows, len(rows))


def test_block_pairs_are_pruned(spark):
    """On a skewed set of five objectives most pairs of blocks are never compared, and the front is the same."""
    rng = np.random.default_rng(5)
    rows = rng.pareto(1.5, (3_000, 5)) + rng.random((3_000, 5)) * 1e-3
    names = [f"o{i}" for i in range(1, 6)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))
    laid = pareto._in_blocks(pareto._in_cells(pareto.vectors(df, names), names, 100), names, 100)
    boxes = pareto.corners(laid, names)
    blocks, pairs = boxes.count(), pareto.block_pairs(boxes, names).count()
    assert blocks >= 30 and pairs < 0.25 * blocks * blocks
    front = {r["id"] for r in pareto.pareto_front(df, names, block_rows=100, window=8, best_rows=4).collect()}
    worse = [np.any(np.all(rows <= r, axis=1) & np.any(rows < r, axis=1)) for r in rows]
    assert front == {i for i, w in enumerate(worse) if not w}
