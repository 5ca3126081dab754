"""Table profiles: counts, sums, means, bounds, missing cells, observed against imputed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.session import free, stored


def unpivot_stats(row: DataFrame, names: Sequence[str], stats: Sequence[str], label: str = "column") -> DataFrame:
    """One row holding `<stat>__<name>` columns to one row per name."""
    structs = [
        F.struct(F.lit(n).alias(label), *[F.col(f"{s}__{n}").alias(s) for s in stats]) for n in names
    ]
    return row.select(F.inline(F.array(*structs)))


def scan_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, missing cells and range of each numeric column, in one pass."""
    aggs = []
    for c in cols:
        aggs += [
            F.count(F.lit(1)).alias(f"n_rows__{c}"),
            F.count_if(F.col(c).isNull()).alias(f"n_missing__{c}"),
            F.min(c).cast("double").alias(f"low__{c}"),
            F.max(c).cast("double").alias(f"high__{c}"),
        ]
    return unpivot_stats(df.agg(*aggs), cols, ["n_rows", "n_missing", "low", "high"])


def domain_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def column_sums(df: DataFrame, cols: Sequence[str], where: Column) -> DataFrame:
    return df.where(where).agg(*[F.sum(c).alias(c) for c in cols])


def histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


NOT_ONE_FLAG = "some rows have more or fewer than one process flag"


def breaks_one_hot(flags: Sequence[str] = tuple(K.PROCESS_FLAGS)) -> Column:
    """Whether the flags do not add up to exactly one."""
    return sum((F.coalesce(F.col(f), F.lit(0)) for f in flags[1:]), F.coalesce(F.col(flags[0]), F.lit(0))) != 1


def onehot_violations(df: DataFrame, flags: Sequence[str] = tuple(K.PROCESS_FLAGS)) -> DataFrame:
    """Rows whose flags do not add up to exactly one."""
    return df.where(breaks_one_hot(flags))


def require_one_hot(df: DataFrame, flags: Sequence[str] = tuple(K.PROCESS_FLAGS)) -> None:
    """Fail the job when any row breaks the one-flag rule."""
    if not onehot_violations(df, flags).isEmpty():
        raise ValueError(NOT_ONE_FLAG)


def stored_one_hot(df: DataFrame, among: Column, flags: Sequence[str] = tuple(K.PROCESS_FLAGS)) -> DataFrame:
    """The table stored; rows `among` those named that break the one-flag rule are counted by the job that writes it, and
    any of them fails it."""
    counts = Observation()
    held = stored(df.observe(counts, F.count_if(among & breaks_one_hot(flags)).alias("broken")))
    if counts.get["broken"]:
        free(held)
        raise ValueError(NOT_ONE_FLAG)
    return held


def missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing cells per column and, as column `(total)`, over all of them."""
    names = [*cols, "(total)"]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_missing__{c}") for c in cols])
    total = sum((F.col(f"n_missing__{c}") for c in cols[1:]), F.col(f"n_missing__{cols[0]}"))
    return unpivot_stats(counts.withColumn("n_missing__(total)", total), names, ["n_missing"])


def composition_bounds(wide: DataFrame) -> DataFrame:
    """Smallest and largest amount per element over all alloys; absent elements count as 0."""
    aggs = [F.expr(f"{fn}({e}) AS {s}__{e}") for e in K.ELEMENTS for fn, s in (("min", "low"), ("max", "high"))]
    rows = ", ".join(f"struct('{e}' AS elem, low__{e} AS low, high__{e} AS high)" for e in K.ELEMENTS)
    return wide.agg(*aggs).selectExpr(f"inline(array({rows}))")


def bounds_row(wide: DataFrame) -> DataFrame:
    """The same bounds as one row of two arrays in element order."""
    lists = {s: ", ".join(f"{fn}({e})" for e in K.ELEMENTS) for s, fn in (("low", "min"), ("high", "max"))}
    return wide.agg(*[F.expr(f"array({items}) AS {s}") for s, items in lists.items()])


def domain_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy("domain").agg(*[F.avg(c).alias(c) for c in cols])


def observed_vs_imputed(joined: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Count, range and mean of the observed and imputed version of each column, in one pass."""
    aggs, names = [], []
    for name, (seen, filled) in pairs.items():
        for kind, c in (("observed", seen), ("imputed", filled)):
            names.append((name, kind))
            aggs.append(
                F.struct(
                    F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.count(c).alias("n"),
                    F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"),
                ).alias(f"{name}_{kind}")
            )
    return joined.agg(*aggs).select(F.inline(F.array(*[F.col(f"{n}_{k}") for n, k in names])))


def sample_notes(df: DataFrame, n: int = 20) -> DataFrame:
    """First n corrosion rows, by row_id, that carry a processing note."""
    return (
        df.where((F.col("domain") == "corrosion") & F.col("phrase").isNotNull() & (F.col("phrase") != "0"))
        .select("row_id", "phrase", "process_class")
        .orderBy("row_id")
        .limit(n)
    )


def mean_impute(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Missing cells replaced by the column mean; the means are one scalar subquery, not a join.
    With a suffix the filled columns stand beside the observed ones, so comparing them needs no join either."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    return df.withColumn("_means", means).withColumns(
        {f"{c}{suffix}": F.coalesce(F.col(c), F.col("_means")[c]) for c in cols}
    ).drop("_means")
