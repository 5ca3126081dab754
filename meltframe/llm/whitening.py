"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

1. Entries become integers, floor(64 c) + 1000000. The fit list holds each distinct vector once. Its scatter S = n sum(x x') - sum(x) sum(x)'
   is an integer matrix, n * n times the covariance; tasks add up exact partial sums, so it does not depend on their order.
2. The polynomial det(t I - S) is computed modulo many primes below 2^31, a task per prime: reduction to Hessenberg form, then the
   recurrence over its leading blocks. Chinese remaindering gives the integer coefficients; an extra prime checks them.
3. All roots of it are real, so the sign changes of the coefficients shifted to a point count the roots above that point exactly. Bisection
   on these counts isolates the largest roots, and bisection on exact signs refines each to 80 bits; roots that cannot be told apart
   within 80 bits are one root with a multiplicity.
4. A component is found in the null space of S - root I by inverse iteration in decimal arithmetic of 60 digits, a task per root; the
   vectors of a multiple root are made orthogonal.
Only values bounded by the dimension d reach the driver: d * d sums, d + 1 coefficients, 16 components.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry go; where lengths differ, rows of another length than
the most frequent one (the larger of equally frequent ones) go too; components of variance zero do not exist, so a table whose vectors are
all equal gives no rows, and neither does an empty table; rows that repeat an id or a vector are rows of the result, while the fit
list has one of them; other columns are ignored. An entry beyond 2^40 in size fails the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltframe.session import stored

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40
COMPONENTS = 16
ROOT_BITS = 80
DIGITS = 60
SUM_SCHEMA = "i int, j int, value decimal(38,0)"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (the entries without the shift, which cancels in everything below) of the rows that take part."""
    c = F.col("embedding")
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), c.alias("embedding")).where(c.isNotNull() & (F.size(c) > 0) & whole)
    x = F.transform(c, lambda v: F.when(F.abs(v) < LARGEST, F.floor(v.cast("double") * SCALE)).otherwise(
        F.raise_error(F.lit("an entry of a vector is too large")).cast("bigint")))
    return rows.select("vec_id", x.alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task: the number of rows at (-1, -1), sums of entries at (-1, j), of products at (i, j) with i <= j."""
    n, sums, products = 0, 0, 0
    for batch in batches:
        x = matrix_of(batch["x"])
        top = int(np.abs(x).max()) if len(x) else 0
        if top * top * max(1, len(x)) < 1 << 53:
            y = x.astype(np.float64)  # every partial sum is an integer below 2^53
            some, squares = y.sum(axis=0).astype(np.int64), (y.T @ y).astype(np.int64)
        else:
            y = x.astype(object)
            some, squares = y.sum(axis=0), y.T @ y
        n, sums, products = n + len(x), sums + some.astype(object), products + squares.astype(object)
    if n:
        d = len(sums)
        upper = np.triu_indices(d)
        i = np.concatenate([[-1], np.full(d, -1), upper[0]])
        j = np.concatenate([[-1], np.arange(d), upper[1]])
        values = [Decimal(int(v)) for v in (n, *sums, *products[upper])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "value"])


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums of their entries, and the integer scatter matrix."""
    sums = fit.mapInArrow(_add_up, SUM_SCHEMA).groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    value = {(r["i"], r["j"]): int(r["value"]) for r in sums}
    n = value.get((-1, -1), 0)
    total = [value[-1, j] for j in range(sum(1 for i, j in value if i < 0 <= j))]
    d = len(total)
    return n, total, [[n * value[min(i, j), max(i, j)] - total[i] * total[j] for j in range(d)] for i in range(d)]


def primes_below(limit: int) -> Iterator[int]:
    """Primes in falling order; the test is exact for numbers below 3 215 031 751."""
    for p in range(limit - 1 - limit % 2, 2, -2):
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            x = pow(base, odd, p)
            if x in (1, p - 1) or p == base:
                continue
            if not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
                break
        else:
            yield p


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t I - a) modulo p, the constant first."""
    a = a.copy()
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            a[[k + 1, at]] = a[[at, k + 1]]
            a[:, [k + 1, at]] = a[:, [at, k + 1]]
        factor = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - factor[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * factor % p).sum(axis=1)) % p
    blocks = np.zeros((d + 1, d + 1), np.int64)
    blocks[0, 0] = 1
    for m in range(1, d + 1):
        out = np.zeros(d + 1, np.int64)
        out[1:] = blocks[m - 1, :-1]
        weights, down = np.empty(m, np.int64), 1
        weights[m - 1] = a[m - 1, m - 1]
        for i in range(m - 2, -1, -1):
            down = down * int(a[i + 1, i]) % p
            weights[i] = down * int(a[i, m - 1]) % p
        blocks[m] = (out - (weights[:, None] * blocks[:m] % p).sum(axis=0)) % p
    return blocks[d]


def characteristic(spark: SparkSession, s: list[list[int]]) -> list[int]:
    """Integer coefficients of det(t I - s), the constant first; s has no negative eigenvalue."""
    d, trace = len(s), sum(s[i][i] for i in range(len(s)))
    # the elementary symmetric functions of d numbers with this sum are largest where all are equal
    bound = max(math.comb(d, k) * Fraction(trace, d) ** k for k in range(d + 1))
    primes, modulus = [], 1
    for p in primes_below(1 << 31):
        primes.append(p)
        if modulus > 2 * bound + 1:
            break  # one prime more than needed, for the check
        modulus *= p

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch["p"].to_pylist():
                rest = np.array([[v % p for v in row] for row in s], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_mod(rest, p).tolist()], pa.list_(pa.int64()))], ["p", "c"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    found = {r["p"]: r["c"] for r in table.mapInArrow(reduce, "p long, c array<long>").collect()}
    modulus, coefficients = 1, [0] * (d + 1)
    for p in primes[:-1]:
        inverse = pow(modulus, -1, p)
        coefficients = [c + modulus * ((r - c) * inverse % p) for c, r in zip(coefficients, found[p])]
        modulus *= p
    coefficients = [c - modulus if 2 * c > modulus else c for c in coefficients]
    if any((c - r) % primes[-1] for c, r in zip(coefficients, found[primes[-1]])):
        raise ArithmeticError("the characteristic polynomial does not agree with its check prime")
    return coefficients


@dataclass(frozen=True)
class Root:
    value: Fraction
    count: int


class RealRoots:
    """Positive roots of a polynomial that has real roots only, at points a / 2^s."""

    def __init__(self, coefficients: list[int]):
        self.c = coefficients
        self.d = len(coefficients) - 1

    def scaled(self, s: int) -> list[int]:
        return [c << s * (self.d - k) for k, c in enumerate(self.c)]

    def above(self, a: int, s: int) -> int:
        """Number of roots greater than a / 2^s, each as often as it occurs: sign changes after the shift."""
        c = self.scaled(s)
        for low in range(self.d):
            for k in range(self.d - 1, low - 1, -1):
                c[k] += a * c[k + 1]
        signs = [v > 0 for v in c if v]
        return sum(x != y for x, y in zip(signs, signs[1:]))

    def sign(self, a: int, s: int) -> int:
        out = 0
        for c in reversed(self.scaled(s)):
            out = out * a + c
        return (out > 0) - (out < 0)

    def refine(self, low: int, high: int, s: int) -> Fraction:
        """The only root in (low, high] / 2^s."""
        end = self.sign(high, s)
        if not end:
            return Fraction(high, 1 << s)
        while (high - low) << ROOT_BITS > low:
            low, high, s = 2 * low, 2 * high, s + 1
            middle = (low + high) // 2
            here = self.sign(middle, s)
            if not here:
                return Fraction(middle, 1 << s)
            low, high = (low, middle) if here == end else (middle, high)
        return Fraction(low + high, 2 << s)

    def largest(self, most: int, limit: int) -> list[Root]:
        """The largest positive roots, `most` in all; none is above `limit`."""
        found: list[Root] = []
        # intervals (low, high] with the numbers of roots above their ends, the highest on top
        open_ = [(0, limit + 1, 0, self.above(0, 0), 0)]
        while open_ and sum(r.count for r in found) < most:
            low, high, s, over_low, over_high = open_.pop()
            inside = over_low - over_high
            if not inside:
                continue
            if inside == 1:
                found.append(Root(self.refine(low, high, s), 1))
            elif low and (high - low) << ROOT_BITS <= low:
                found.append(Root(Fraction(low + high, 2 << s), inside))
            else:
                if high - low == 1:
                    low, high, s = 2 * low, 2 * high, s + 1
                middle = (low + high) // 2
                over = self.above(middle, s)
                open_ += [(low, middle, s, over_low, over), (middle, high, s, over, over_high)]
        return found


def null_space(s: list[list[int]], root: Decimal, count: int) -> list[list[float]]:
    """`count` orthonormal vectors that s maps to root times themselves, by inverse iteration; the largest entry of each is positive."""
    with localcontext() as context:
        context.prec = DIGITS
        d = len(s)
        rows = [[Decimal(v) for v in row] for row in s]
        for i in range(d):
            rows[i][i] -= root
        smallest = max(abs(v) for row in rows for v in row) * Decimal(10) ** (5 - DIGITS) or Decimal(1)
        order, lower = list(range(d)), [[] for _ in range(d)]
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(rows[i][k]))
            for table in (rows, order, lower):
                table[k], table[best] = table[best], table[k]
            if abs(rows[k][k]) < smallest:
                rows[k][k] = smallest
            pivot = rows[k]
            for i in range(k + 1, d):
                factor = rows[i][k] / pivot[k]
                lower[i].append(factor)
                if factor:
                    rows[i][k:] = [a - factor * b for a, b in zip(rows[i][k:], pivot[k:])]

        def solve(v: list[Decimal]) -> list[Decimal]:
            y: list[Decimal] = []
            for i in range(d):
                y.append(v[order[i]] - sum((f * w for f, w in zip(lower[i], y)), Decimal(0)))
            for i in reversed(range(d)):
                y[i] = (y[i] - sum((a * b for a, b in zip(rows[i][i + 1:], y[i + 1:])), Decimal(0))) / rows[i][i]
            return y

        out: list[list[Decimal]] = []
        for k in range(count):
            v = [Decimal((i * 7_919 + k * 104_729 + 1) % 1_009 + 1) for i in range(d)]
            for _ in range(4):
                v = solve(v)
                for _ in range(2):
                    for u in out:
                        along = sum((a * b for a, b in zip(u, v)), Decimal(0))
                        v = [a - along * b for a, b in zip(v, u)]
                    norm = sum((a * a for a in v), Decimal(0)).sqrt()
                    v = [a / norm for a in v]
            top = max(v, key=abs)
            out.append([-a for a in v] if top < 0 else v)
        return [[float(a) for a in v] for v in out]


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size and sums, and per component the unit vector, the scatter's root and the share of variance."""

    n: int
    sums: list[int]
    vectors: list[list[float]]
    roots: list[float]
    explained: list[float]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - sum, exactly: integers of 64 bits where they fit, of any size otherwise."""
        top = int(np.abs(x).max()) if len(x) else 0
        fits = (self.n * top + max(map(abs, self.sums))) ** 2 * len(self.sums) < 1 << 62
        return x * self.n - np.array(self.sums) if fits else x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened components of deviations."""
        return y.astype(np.float64) @ np.array(self.vectors).T / np.sqrt(np.array(self.roots))


def components(spark: SparkSession, s: list[list[int]], most: int) -> tuple[list[list[float]], list[Fraction]]:
    """Unit vectors and roots of the scatter, largest root first."""
    trace = sum(s[i][i] for i in range(len(s)))
    if not trace:
        return [], []
    roots = RealRoots(characteristic(spark, s)).largest(most, trace)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, above, below, count in zip(*(batch[c].to_pylist() for c in ("k", "above", "below", "count"))):
                with localcontext() as context:
                    context.prec = DIGITS
                    found = null_space(s, Decimal(above) / Decimal(below), count)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([found], pa.list_(pa.list_(pa.float64())))], ["k", "vectors"])

    rows = [(k, str(r.value.numerator), str(r.value.denominator), r.count) for k, r in enumerate(roots)]
    table = spark.createDataFrame(rows, "k long, above string, below string, count int").repartition(len(rows))
    solved = {r["k"]: r["vectors"] for r in table.mapInArrow(solve, "k long, vectors array<array<double>>").collect()}
    out = [(v, roots[k].value) for k in range(len(roots)) for v in solved[k]][:most]
    return [v for v, _ in out], [r for _, r in out]


def fit(rows: DataFrame, most: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of a table of integer vectors of one length, and its fit list."""
    distinct = stored(rows.select("x").distinct())
    n, sums, s = scatter(distinct)
    vectors, roots = components(rows.sparkSession, s, most)
    trace = sum(s[i][i] for i in range(len(s)))
    return Whitening(n, sums, vectors, [float(r) for r in roots], [float(r / trace) for r in roots]), distinct


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; centred before multiplying."""
    k = len(model.roots)
    schema = "i int, j int, value double"

    def partial(centre: np.ndarray | None):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                w = model.project(model.deviations(matrix_of(batch["x"])))
                total = total + (w.sum(axis=0, keepdims=True) if centre is None else (w - centre).T @ (w - centre))
            if not np.isscalar(total):
                i, j = np.indices(total.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "value"])
        return add

    def added(centre: np.ndarray | None, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape)
        for r in distinct.mapInArrow(partial(centre), schema).groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
            out[r["i"], r["j"]] = r["value"] / model.n
        return out

    centre = added(None, (1, k))
    return float(np.abs(added(centre, (k, k)) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained: a row per vector and component."""
    k = len(model.roots)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2_048):
                batch = whole.slice(start, 2_048)
                y = model.deviations(matrix_of(batch["x"]))
                m = len(y)
                yield pa.RecordBatch.from_arrays([
                    batch["vec_id"].take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n, np.int64)), pa.array(np.repeat((y * y).sum(axis=1), k), pa.int64()),
                    pa.array(model.project(y).ravel()), pa.array(np.tile(model.explained, m))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(apply, RESULT)


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector that takes part."""
    rows = integers(vectors)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is not None:
        rows = rows.where(F.size("x") == lengths["d"])
        model, distinct = fit(rows, most)
        if model.roots:
            return transform(rows, model).withColumn("identity_error", F.lit(identity_error(distinct, model)))
    return vectors.sparkSession.createDataFrame([], f"{RESULT}, identity_error double")
