"""Non-dominated sets on Spark: Pareto front, front ranks and crowding distance.

All objectives are minimised. Every step works on distinct objective vectors, so any number of equal
rows costs one vector. The front is found in three exact steps:

1. each scan partition drops what its own rows dominate, before anything is shuffled;
2. the survivors are made distinct and stored; the best of them by normalised objective sum, a bounded number, filter
   the rest once more;
3. what is left is cut into cells, a grid of quantile strips of every objective, and cells with many vectors into blocks of bounded
   size. A pair of blocks is compared, in a group of its own (`cogroup`), only where the smallest corner of the one is nowhere above
   the largest corner of the other; only for those pairs are rows copied. Vectors dominated in any pair go.

Dominance is transitive and irreflexive, so a dominated vector is dominated by some member of the front,
and members of the front survive step 1: the result is the whole front whatever the partitioning.

Ranks come from one sweep over the same kind of grid, not from one front after the other. A vector can only be dominated from cells whose
coordinates are nowhere larger, so cells with equal coordinate sums are independent of each other and are ranked together, in the order of
the sums: with g strips and m objectives that is m (g - 1) + 1 steps, however many fronts there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meltframe.session import free, stored

BLOCK_ROWS = 16384  # vectors a single task compares with each other
WINDOW_ROWS = 4096  # vectors a scan task holds as its filter
BEST_ROWS = 1024  # vectors every task of the second filter holds
BROADCAST_ROWS = 200_000  # rows of a counted side that is broadcast
CELL_ROWS = 4096  # vectors of a cell in which ranks are found, about
BUCKET_VALUES = 20_000  # distinct values a crowding bucket sorts


def dominated_by(rows: np.ndarray, by: np.ndarray, or_equal: bool = False, step: int = 1024) -> np.ndarray:
    """Mask of the rows dominated by (or, if asked, equal to) at least one row of `by`."""
    out = np.zeros(len(rows), dtype=bool)
    for start in range(0, len(by), step):
        open_rows = np.flatnonzero(~out)
        if not len(open_rows):
            break
        part, todo = by[start:start + step], rows[open_rows]
        hit = np.zeros(len(todo), dtype=bool)
        for at in range(0, len(todo), step):
            chunk = todo[at:at + step]
            no_worse = np.ones((len(part), len(chunk)), dtype=bool)
            better = np.full((len(part), len(chunk)), or_equal)
            for j in range(rows.shape[1]):
                left, right = part[:, j:j + 1], chunk[:, j]
                no_worse &= left <= right
                better |= left < right
            hit[at:at + step] = (no_worse & better).any(axis=0)
        out[open_rows[hit]] = True
    return out


def local_front(rows: np.ndarray, step: int = 512) -> np.ndarray:
    """Distinct non-dominated rows of an array."""
    if not len(rows):
        return rows
    rows = np.unique(rows, axis=0)
    # A dominating row never has the larger (clipped) sum; equal sums fall back to the column order.
    score = np.clip(rows, -1e300, 1e300).sum(axis=1)
    rows = rows[np.lexsort((*rows.T[::-1], score))]
    front = rows[:0]
    for start in range(0, len(rows), step):
        chunk = rows[start:start + step]
        chunk = chunk[~dominated_by(chunk, front)]
        chunk = chunk[~dominated_by(chunk, chunk)]
        front = np.vstack([front, chunk])
    return front


def _matrix(batch, objectives: Sequence[str]) -> np.ndarray:
    cols = [batch.column(o).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch)
            else batch.column(o).to_numpy() for o in objectives]
    return np.column_stack(cols).astype(float) if cols else np.empty((0, 0))


def _scan_filter(objectives: Sequence[str], window: int):
    """Streams a partition against a window of its best vectors and passes on what is not dominated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = np.empty((0, len(objectives)))
        for batch in batches:
            rows = _matrix(batch, objectives)
            rows = local_front(rows[~dominated_by(rows, front, or_equal=True)])
            front = front[~dominated_by(front, rows)]
            room = window - len(front)
            front, spill = np.vstack([front, rows[:room]]), rows[room:]
            if len(spill):  # beyond the window: passed on, the block comparison decides
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in spill.T], names=list(objectives))
        if len(front):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in front.T], names=list(objectives))

    return run


def _table(rows: np.ndarray, objectives: Sequence[str]) -> pa.Table:
    return pa.table({o: pa.array(rows[:, j], type=pa.float64()) for j, o in enumerate(objectives)})


def vectors(points: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Objective columns as DOUBLE, rows with a missing objective left out."""
    cols = [F.col(o).cast("double").alias(o) for o in objectives]
    known = reduce(lambda a, b: a & b, [F.col(o).isNotNull() & ~F.isnan(o) for o in objectives])
    return points.select(*cols).where(known)


def _score(table: DataFrame, objectives: Sequence[str]):
    """Sum of the objectives, each scaled to its range in the table: a dominating vector never has the larger one."""
    ends = table.agg(*[F.min(o).alias(f"lo_{o}") for o in objectives], *[F.max(o).alias(f"hi_{o}") for o in objectives]).first()
    scaled = []
    for o in objectives:
        low, high = ends[f"lo_{o}"], ends[f"hi_{o}"]
        if low is not None and np.isfinite(high - low) and high > low:
            scaled.append((F.col(o) - F.lit(low)) / F.lit(high - low))
    return reduce(lambda a, b: a + b, scaled, F.lit(0.0))


def front_vectors(points: DataFrame, objectives: Sequence[str], block_rows: int = BLOCK_ROWS,
                  window: int = WINDOW_ROWS, best_rows: int = BEST_ROWS) -> DataFrame:
    """Distinct non-dominated objective vectors, as a stored table. One procedure for every size: a small set is one block."""
    objectives = list(objectives)
    schema = ", ".join(f"`{o}` double" for o in objectives)
    first = stored(vectors(points, objectives).mapInArrow(_scan_filter(objectives, window), schema).distinct())
    best = local_front(_matrix(first.orderBy(_score(first, objectives), *objectives).limit(best_rows).toArrow(), objectives))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch, objectives)
            yield from _table(rows[~dominated_by(rows, best)], objectives).to_batches()

    left = stored(first.mapInArrow(drop, schema))
    laid = _in_blocks(_in_cells(left, objectives, block_rows), objectives, block_rows)
    pairs = block_pairs(corners(laid, objectives), objectives)
    target = _beside(laid, pairs.select(F.col("t").alias("block"), "s"), ["block"]).withColumnRenamed("block", "t")
    # columns of their own, since both sides of the cogroup come from one table
    mirror = laid.select(*[F.col(c).alias(c) for c in laid.columns])
    source = _beside(mirror, pairs.select(F.col("s").alias("block"), "t"), ["block"]).withColumnRenamed("block", "s")

    def losers(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows = _matrix(mine, objectives)
        return _table(rows[dominated_by(rows, local_front(_matrix(theirs, objectives)))], objectives)

    dominated = target.groupBy("t", "s").cogroup(source.groupBy("t", "s")).applyInArrow(losers, schema)
    front = stored(left.join(dominated.distinct(), objectives, "left_anti"))
    free(first, left, laid, pairs)
    return front


def _in_cells(table: DataFrame, objectives: Sequence[str], rows: int) -> DataFrame:
    """Add `at`, the strip of each objective: as many strips as make cells of about `rows` vectors, cut at quantiles."""
    cells = table.count() / rows
    strips = 1 if cells <= 1 else max(2, math.ceil(cells ** (1 / len(objectives))))
    cuts = table.approxQuantile(list(objectives), [i / strips for i in range(1, strips)], 1 / (50 * strips)) if strips > 1 else []
    at = [reduce(lambda a, b: a + b, [(F.col(o) > F.lit(c)).cast("int") for c in sorted(set(c_of))], F.lit(0))
          for o, c_of in zip(objectives, cuts or [[]] * len(objectives), strict=True)]
    return table.withColumn("at", F.array(*at))


def _in_blocks(table: DataFrame, objectives: Sequence[str], rows: int) -> DataFrame:
    """Stored table with `block`: a cell, or a hashed part of one that holds more than `rows` vectors."""
    table = stored(table)
    sizes = stored(table.groupBy("at").agg(F.ceil(F.count("*") / rows).alias("parts")))
    part = F.pmod(F.xxhash64(*objectives), F.col("parts"))
    return stored(_beside(table, sizes, ["at"]).withColumn("block", F.concat_ws(",", F.col("at").cast("array<string>"), part)).drop("parts"))


def corners(blocks: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """A row per block: its cell and the least and largest value of every objective."""
    return stored(blocks.groupBy("block", "at").agg(
        F.array(*[F.min(o) for o in objectives]).alias("low"), F.array(*[F.max(o) for o in objectives]).alias("high")))


def block_pairs(boxes: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """(t, s, whole): block s may hold vectors that dominate some of block t; `whole`: all of s dominate all of t.

    A source's strip of the first objective cannot be above the target's, so pairs are joined strip by strip.
    """
    first = F.get("at", F.lit(0))
    target = boxes.select(F.col("block").alias("t"), F.col("high").alias("t_high"), F.col("low").alias("t_low"), F.explode(F.sequence(F.lit(0), first)).alias("strip"))
    source = boxes.select(F.col("block").alias("s"), F.col("low").alias("s_low"), F.col("high").alias("s_high"), first.alias("strip"))
    m = range(len(objectives))
    may = reduce(lambda a, b: a & b, [F.get("s_low", F.lit(j)) <= F.get("t_high", F.lit(j)) for j in m])
    below = reduce(lambda a, b: a & b, [F.get("s_high", F.lit(j)) <= F.get("t_low", F.lit(j)) for j in m])
    strictly = reduce(lambda a, b: a | b, [F.get("s_high", F.lit(j)) < F.get("t_low", F.lit(j)) for j in m])
    return stored(target.join(source, "strip").where(may).select("t", "s", (below & strictly).alias("whole")))


def _match(points: DataFrame, found: DataFrame, objectives: Sequence[str], how: str) -> DataFrame:
    """Join the points to a vector table on all objectives, whatever their numeric type."""
    names = [f"_v_{o}" for o in objectives]
    keyed = found.withColumnsRenamed(dict(zip(objectives, names, strict=True)))
    condition = reduce(
        lambda a, b: a & b,
        [points[o].cast("double") == keyed[n] for o, n in zip(objectives, names, strict=True)],
    )
    return points.join(keyed, condition, how).drop(*names)


def pareto_front(points: DataFrame, objectives: Sequence[str], feasible: str | None = None, **options) -> DataFrame:
    """Feasible rows no other feasible row dominates; equal rows all stay."""
    if feasible:
        points = points.where(F.col(feasible))
    return _match(points, front_vectors(points, objectives, **options), objectives, "left_semi")


def dominator_ranks(rows: np.ndarray, by: np.ndarray, ranks: np.ndarray, step: int = 1024) -> np.ndarray:
    """For each row the largest rank among the rows of `by` that dominate it; 0 where none does."""
    out = np.zeros(len(rows), dtype=np.int64)
    for at in range(0, len(rows), step):
        chunk = rows[at:at + step]
        for start in range(0, len(by), step):
            part = by[start:start + step]
            no_worse, better = np.ones((len(part), len(chunk)), dtype=bool), np.zeros((len(part), len(chunk)), dtype=bool)
            for j in range(rows.shape[1]):
                left, right = part[:, j:j + 1], chunk[:, j]
                no_worse &= left <= right
                better |= left < right
            found = np.where(no_worse & better, ranks[start:start + step, None], 0).max(axis=0)
            out[at:at + step] = np.maximum(out[at:at + step], found)
    return out


def local_ranks(rows: np.ndarray, least: np.ndarray, step: int = 256) -> np.ndarray:
    """Ranks of distinct rows among themselves, none below its `least`."""
    # a dominating row comes earlier: it never has the larger (clipped) sum, and equal sums fall back to the column order
    order = np.lexsort((*rows.T[::-1], np.clip(rows, -1e300, 1e300).sum(axis=1)))
    rows, out = rows[order], least[order].copy()
    for start in range(0, len(rows), step):
        chunk = rows[start:start + step]
        now = np.maximum(out[start:start + step], dominator_ranks(chunk, rows[:start], out[:start]) + 1)
        while True:  # chains inside the chunk, one link at a time
            after = np.maximum(now, dominator_ranks(chunk, chunk, now) + 1)
            if (after == now).all():
                break
            now = after
        out[start:start + step] = now
    back = np.empty_like(out)
    back[order] = out
    return back


def pareto_rank(points: DataFrame, objectives: Sequence[str], max_rank: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add `pareto_rank`: 1 for the front, 2 for the front of what remains, and so on to the last row.

    A rank is one more than the largest among the vectors that dominate, so cells are ranked in the order of their coordinate sums, each
    from the ranked cells below it. Of a cell that lies below in every objective only its largest rank is looked at. With `max_rank`
    larger ranks are NULL. Rows with a missing objective have no rank. Vectors that no strip can separate (an objective with few
    values) share a cell.
    """
    objectives = list(objectives)
    table = _in_cells(stored(vectors(points, objectives).distinct()), objectives, cell_rows)
    table = stored(table.withColumn("block", F.concat_ws(",", F.col("at").cast("array<string>"))).withColumn(
        "step", F.aggregate("at", F.lit(0), lambda a, b: a + b)))
    steps = sorted(r[0] for r in table.select("step").distinct().collect())
    if not steps:
        return points.withColumn("pareto_rank", F.lit(None).cast("int"))
    pairs = block_pairs(corners(table, objectives), objectives).where("t <> s")
    keep = ", ".join(f"`{o}` double" for o in objectives)

    def found_in(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows, by = _matrix(mine, objectives), _matrix(theirs, objectives)
        best = dominator_ranks(rows, by, theirs["pareto_rank"].to_numpy().astype(np.int64)) if len(by) else np.zeros(len(rows), np.int64)
        return _table(rows[best > 0], objectives).append_column("best", pa.array(best[best > 0]))

    def ranks_in(mine: pa.Table) -> pa.Table:
        rows = _matrix(mine, objectives)
        out = local_ranks(rows, mine["least"].to_numpy().astype(np.int64))
        return _table(rows, objectives).append_column("block", mine["block"]).append_column("pareto_rank", pa.array(out, pa.int32()))

    done: list[DataFrame] = []
    for step in steps:
        mine = table.where(F.col("step") == step).select(*objectives, "block")
        least = F.lit(1)
        if done:
            ranked = reduce(DataFrame.unionByName, done)
            here = stored(pairs.join(mine.select(F.col("block").alias("t")).distinct(), "t"))
            part = here.where("not whole")
            target = _beside(mine, part.select(F.col("t").alias("block"), "s"), ["block"]).withColumnRenamed("block", "t")
            source = _beside(ranked, part.select(F.col("s").alias("block"), "t"), ["block"]).withColumnRenamed("block", "s")
            above = target.groupBy("t", "s").cogroup(source.groupBy("t", "s")).applyInArrow(found_in, f"{keep}, best long")
            above = stored(above.groupBy(*objectives).agg(F.max("best").alias("best")))
            tops = ranked.groupBy(F.col("block").alias("s")).agg(F.max("pareto_rank").alias("top"))
            floors = stored(here.where("whole").join(tops, "s").groupBy(F.col("t").alias("block")).agg(F.max("top").alias("floor")))
            mine = mine.join(above, objectives, "left").join(floors, "block", "left")
            least = F.greatest(F.coalesce("best", F.lit(0)), F.coalesce("floor", F.lit(0))) + 1
        rows = mine.select(*objectives, "block", least.cast("long").alias("least"))
        done.append(stored(rows.groupBy("block").applyInArrow(ranks_in, f"{keep}, block string, pareto_rank int")))
    ranked = reduce(DataFrame.unionByName, done).drop("block")
    if max_rank is not None:
        ranked = ranked.where(F.col("pareto_rank") <= max_rank)
    return _match(points, ranked, objectives, "left")


def _beside(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join with a stored table: broadcast up to a counted size, shuffled beyond it."""
    return df.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, list(keys))


def _neighbours(values: DataFrame, by: Sequence[str], bucket_values: int) -> DataFrame:
    """Previous and next distinct value (`below`, `above`) of `v` within each group of `by`.

    A group may hold any share of the values, so it is not sorted in one task: quantiles cut it into buckets of about
    `bucket_values`, neighbours are looked up inside each bucket, and bucket edges are joined from a small table.
    """
    most = values.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    buckets = -(-most // bucket_values)
    cuts = [i / buckets for i in range(1, buckets)]
    placed = values.withColumn("bucket", F.lit(0))
    if cuts:
        bounds = stored(values.groupBy(*by).agg(F.percentile_approx("v", cuts, 10 * len(cuts) + 1000).alias("bounds")))
        placed = _beside(values, bounds, by).withColumn("bucket", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds")
    inside = Window.partitionBy(*by, "bucket").orderBy("v")
    near = placed.withColumns({"_below": F.lag("v").over(inside), "_above": F.lead("v").over(inside)})
    along = Window.partitionBy(*by).orderBy("bucket")
    edges = stored(
        placed.groupBy(*by, "bucket")
        .agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        .select(*by, "bucket", F.lag("_hi").over(along).alias("_edge_below"), F.lead("_lo").over(along).alias("_edge_above"))
    )
    return _beside(near, edges, [*by, "bucket"]).select(
        *by, "v", "first_id", "last_id", F.coalesce("_below", "_edge_below").alias("below"),
        F.coalesce("_above", "_edge_above").alias("above"),
    )


def crowding_distance(ranked: DataFrame, objectives: Sequence[str], key: str = "id",
                      bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """Add `crowding`: gap between the neighbours of a row within its rank, relative to the objective's range,
    averaged over objectives. Rows at an end of any objective get NULL, as do rows without a rank; an objective
    without range adds 0.

    Neighbours are taken in (objective, key) order. Rows sharing a value are neighbours of each other except
    at the two ends of the run, so only distinct values have to be sorted. The objectives of a row become rows of one
    long table, so all of them take the same few steps. `key` is unique.
    """
    by = ["objective", "pareto_rank"]
    pairs = F.array(*[F.struct(F.lit(i).alias("objective"), F.col(o).cast("double").alias("v")) for i, o in enumerate(objectives)])
    long = stored(ranked.where(F.col("pareto_rank").isNotNull()).select(F.col(key).alias("_key"), "pareto_rank", F.inline(pairs)))
    values = stored(long.groupBy(*by, "v").agg(F.min("_key").alias("first_id"), F.max("_key").alias("last_id")))
    spans = stored(values.groupBy(*by).agg((F.max("v") - F.min("v")).alias("span")))
    near = stored(_beside(_neighbours(values, by, bucket_values), spans, by))
    below = F.when(F.col("_key") == F.col("first_id"), F.col("below")).otherwise(F.col("v"))
    above = F.when(F.col("_key") == F.col("last_id"), F.col("above")).otherwise(F.col("v"))
    gap = F.when(F.col("span") > 0, (above - below) / F.col("span")).when(above.isNotNull() & below.isNotNull(), F.lit(0.0))
    gaps = _beside(long, near, [*by, "v"]).select("_key", "objective", gap.alias("gap"))
    at = [F.max(F.when(F.col("objective") == i, F.col("gap"))).alias(f"_gap_{i}") for i in range(len(objectives))]
    total = reduce(lambda a, b: a + b, [F.col(f"_gap_{i}") for i in range(len(objectives))])
    crowding = stored(gaps.groupBy("_key").agg(*at).select("_key", (total / F.lit(float(len(objectives)))).alias("crowding")))
    return ranked.join(crowding, ranked[key] == crowding["_key"], "left").drop("_key")
