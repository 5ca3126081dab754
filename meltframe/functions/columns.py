"""Column expressions for derived columns: flags, scaling, missing values, clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltframe import constants as K


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def one_hot(col: str, values: Sequence, names: Sequence[str]) -> dict[str, Column]:
    """One flag column per value; NULL and unlisted values give all zeros."""
    return {n: flag(F.col(col) == F.lit(v)) for v, n in zip(values, names, strict=True)}


def electrolyte_flags(col: str = "electrolyte") -> dict[str, Column]:
    return one_hot(col, K.ELECTROLYTES, K.ELECTROLYTE_FLAGS)


def process_flags(col: str = "process_class") -> dict[str, Column]:
    return one_hot(col, range(1, 8), K.PROCESS_FLAGS)


def concentration_norm(col: str = "concentration_m") -> Column:
    return F.coalesce(F.col(col), F.lit(0.0)) / F.lit(K.MAX_CONCENTRATION_M)


def zero_as_missing(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(0.0))


def log10_positive(col: str) -> Column:
    return F.when(F.col(col) > 0, F.log10(col))


def clamp(col: Column, low: float, high: float) -> Column:
    """Bounded value; NULL stays NULL (least and greatest would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def clip_to_rule(name: str, col: Column | None = None) -> Column:
    col = F.col(name) if col is None else col
    return clamp(col, *K.CLIP_RULES[name]) if name in K.CLIP_RULES else col


def icorr_from_log(col: Column) -> Column:
    """Current density from its log10, kept within 0 and the ceiling."""
    return clamp(F.pow(F.lit(10.0), col), 0.0, K.ICORR_CEILING)


def observed(col: str) -> Column:
    return F.col(col).isNotNull().cast("int")


def update_where(mask: Column, new: Column, old: Column) -> Column:
    """`new` on rows where the mask is true, `old` on all others."""
    return F.when(F.coalesce(mask, F.lit(False)), new).otherwise(old)


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(cols))


def prepare_targets(df: DataFrame) -> DataFrame:
    """Zero as missing on the raw targets, then log10 of the positive current densities."""
    cleaned = df.withColumns({t: zero_as_missing(t) for t in K.RAW_TARGETS if t in df.columns})
    return cleaned.withColumn("icorr_log10", log10_positive("icorr"))


def add_test_environment(df: DataFrame) -> DataFrame:
    return df.withColumns({**electrolyte_flags(), "conc_norm": concentration_norm()})
