"""Nearest neighbours as a block matrix join: int8 product tiles bound the distances, survivors are recomputed in double precision.

Vectors are packed into blocks: ids, the original components, and an int8 form with a scale and the exact length of the rounding
residue per vector. A tile multiplies the int8 forms of a query block and a candidate block; with d the distance of the rounded vectors
and e the residues' lengths, the true distance lies in [d - e1 - e2, d + e1 + e2]. A pair survives if its lower bound does not exceed
the k-th smallest upper bound of its tile nor the k-th best distance its query has so far. Survivors are measured on the original
vectors and merged into each query's list by a heap; lists of different tasks meet in one ranking per query.

The result is exact: bounds only drop pairs that k others beat. Work is queries times candidates, in matrix products; what is shuffled is a
copy of each candidate block per query block and a copy of each query block per group of candidate blocks.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite component take no part, nor do rows without an id;
distances exist only between vectors of one length; a query's own id is no candidate; repeated rows of a query's id are one query (the
smallest vector), repeated rows of a candidate are candidates each; ties go to the smaller id; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meltframe.session import stored

CANDIDATES_PER_BLOCK = 4_096
QUERIES_PER_BLOCK = 1_024
# Candidate blocks are dealt to at most this many groups, so a query has at most k times as many rows to merge.
GROUPS = 256
BLOCKS_PER_GROUP = 2
QUERY_ROWS_AT_ONCE = 128

PACKED = "dim int, block long, n int, ids binary, vectors binary, rounded binary, scale binary, residue binary"
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    # `x * 0 = 0` holds for finite numbers only
    return F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & (x * 0 == 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding left over (a little rounded up)."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny  # components too small to divide
    rounded = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    left = x - rounded * scale[:, None]
    return rounded, scale, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9)


def _pack(table: pa.Table) -> pa.Table:
    dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
    ids = table["vec_id"].to_numpy().astype("<i8")
    flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
    x = flat.reshape(len(ids), dim)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    rounded, scale, residue = quantise(x)
    values = [dim, block, len(ids), ids.tobytes(), x.tobytes(), rounded.tobytes(), scale.tobytes(), residue.tobytes()]
    schema = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32())] + [
        (name, pa.binary()) for name in ("ids", "vectors", "rounded", "scale", "residue")])
    return pa.table([[v] for v in values], schema=schema)


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict, side: str):
        dim, n = row["dim"], row[f"{side}n"]
        self.ids = np.frombuffer(row[f"{side}ids"], "<i8")
        self.x = np.frombuffer(row[f"{side}vectors"], "<f8").reshape(n, dim)
        # a product of int8 rows is a whole number; floats hold it exactly and multiply by BLAS
        exact = np.float32 if dim * 127 * 127 < 2**24 else np.float64
        self.rounded = np.frombuffer(row[f"{side}rounded"], np.int8).reshape(n, dim).astype(exact)
        self.scale = np.frombuffer(row[f"{side}scale"], "<f8")
        self.residue = np.frombuffer(row[f"{side}residue"], "<f8")
        self.length2 = (self.rounded.astype(np.float64) ** 2).sum(axis=1) * self.scale**2


def bounds(q: Block, c: Block, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of some query rows to all candidates of a block."""
    product = (q.rounded[rows] @ c.rounded.T).astype(np.float64)
    square = q.length2[rows, None] + c.length2 - 2 * product * (q.scale[rows, None] * c.scale)
    middle = np.sqrt(np.maximum(square, 0))
    # the difference of squares loses digits in double precision; the margin covers that
    margin = q.residue[rows, None] + c.residue + 1e-7 * np.sqrt(q.length2[rows, None] + c.length2)
    return middle - margin, middle + margin


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed component by component."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        step = a[:, j] - b[:, j]
        total += step * step
    return np.sqrt(total)


def search_tile(q: Block, c: Block, k: int, best: list[list[tuple[float, int]]]) -> None:
    """Merge the block's candidates into `best`, a sorted list of (distance, id) per query."""
    for start in range(0, len(q.ids), QUERY_ROWS_AT_ONCE):
        rows = slice(start, start + QUERY_ROWS_AT_ONCE)
        lower, upper = bounds(q, c, rows)
        own = q.ids[rows, None] == c.ids
        lower[own] = upper[own] = np.inf
        limit = np.array([b[-1][0] if len(b) == k else np.inf for b in best[rows]])
        if len(c.ids) >= k:
            limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
        at, other = np.nonzero((lower <= limit[:, None]) & ~own)
        if not len(at):
            continue
        found = np.concatenate([distances(q.x[start + at[i:i + 65536]], c.x[other[i:i + 65536]]) for i in range(0, len(at), 65536)])
        order = np.lexsort((c.ids[other], found, at))
        at, other, found = at[order], other[order], found[order]
        first = np.searchsorted(at, np.arange(len(best[rows]) + 1))
        for i in range(len(first) - 1):
            # the list is sorted, so its first k are all that can count
            part = slice(first[i], min(first[i + 1], first[i] + k))
            fresh = zip(found[part].tolist(), c.ids[other[part]].tolist())
            best[start + i] = heapq.nsmallest(k, heapq.merge(best[start + i], fresh))


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, best = None, None, []

        def result() -> pa.RecordBatch:
            rows = [(i, v, d) for i, found in zip(queries.ids.tolist(), best) for d, v in found]
            columns = zip(*rows) if rows else ([], [], [])
            types = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["dim"], row["qblock"]):
                    if key:
                        yield result()
                    key, queries = (row["dim"], row["qblock"]), Block(row, "q")
                    best = [[] for _ in queries.ids]
                search_tile(queries, Block(row, ""), k, best)
        if key:
            yield result()
    return search


def pack(vectors: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """Blocks of about `per_block` vectors by a hash of the id, and the number of blocks."""
    blocks = max(1, math.ceil(vectors.count() / per_block))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return stored(dealt.groupBy("dim", "block").applyInArrow(_pack, PACKED)), blocks


def nearest(table: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest candidates of every row for which `is_query` holds."""
    vectors = table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("vector"))
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("vector", "dim")).alias("v")).select("vec_id", "v.dim", "v.vector")
    packed, blocks = pack(vectors, CANDIDATES_PER_BLOCK)
    asked, qblocks = pack(queries, QUERIES_PER_BLOCK)
    groups = min(GROUPS, math.ceil(blocks / BLOCKS_PER_GROUP))
    asked = asked.select("dim", *[F.col(c).alias(f"q{c}") for c in ("block", "n", "ids", "vectors", "rounded", "scale", "residue")],
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    packed = packed.withColumn("part", F.col("block") % groups).withColumn(
        "qblock", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1)).cast("array<bigint>")))
    # a key holds one query block and a group of candidate blocks; its rows follow each other, so a task keeps one list per query
    tiles = packed.join(asked.hint("merge"), ["dim", "qblock", "part"])
    found = tiles.mapInArrow(_search(k), FOUND)
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
