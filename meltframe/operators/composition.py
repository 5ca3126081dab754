"""Alloy composition: long and wide forms, fractions and the fifteen physics parameters.

The long form has one row per (alloy, element). One hash aggregation turns it into the wide form,
one row per alloy with a DOUBLE amount per element, and everything else is a projection of that row:
a single shuffle, combined before it, whatever the parameter. Because the number of elements is fixed
no row can grow, and the element pairs of an alloy are terms of an expression, not rows of a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltframe import constants as K

TOTAL = "amount_total"
AMOUNTS = "amounts_present"


# Arithmetic over the 32 elements is written as SQL text: one expression string is parsed at once, while the
# same sum built term by term costs thousands of calls into the JVM before the query even starts.

def _add(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _num(value: float) -> str:
    return f"{float(value)!r}D"


# --- dimension tables -------------------------------------------------------------

def element_props(spark: SparkSession) -> DataFrame:
    rows = [
        (i, e, *[K.PROPERTY_VALUES[p][i] for p in K.PROPERTIES]) for i, e in enumerate(K.ELEMENTS)
    ]
    schema = "elem_idx int, elem string, " + ", ".join(f"{p} double" for p in K.PROPERTIES)
    return spark.createDataFrame(rows, schema)


def pair_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, float(h)) for a, b, h in K.PAIRS], "e1 string, e2 string, h double")


def element_lookup(long: DataFrame, props: DataFrame) -> DataFrame:
    """Element properties beside each amount; the property table has one row per element, so it is broadcast."""
    return long.join(F.broadcast(props), "elem_idx")


def pair_lookup(pairs: DataFrame, enthalpies: DataFrame) -> DataFrame:
    """Pair enthalpy of ordered element pairs, 0 where the pair is not listed."""
    return pairs.join(F.broadcast(enthalpies), ["e1", "e2"], "left").withColumn(
        "h", F.coalesce("h", F.lit(0.0))
    )


# --- forms ------------------------------------------------------------------------

def known_elements(long: DataFrame, elem: str = "elem_idx") -> DataFrame:
    """The rows as they are; an element index outside the table fails the job instead of losing its amount."""
    last = len(K.ELEMENTS) - 1
    return long.where(F.expr(
        f"CASE WHEN `{elem}` BETWEEN 0 AND {last} THEN true "
        f"ELSE raise_error(concat('unknown element index ', coalesce(CAST(`{elem}` AS STRING), 'NULL'))) END"))


def to_wide(long: DataFrame, key: str = "row_id", elem: str = "elem_idx", amount: str = "amount") -> DataFrame:
    """One row per alloy, one column per element; repeated (alloy, element) rows add up."""
    long = known_elements(long, elem)
    sums = [
        F.expr(f"CAST(coalesce(sum(CASE WHEN `{elem}` = {i} THEN `{amount}` END), 0) AS DOUBLE) AS {e}")
        for i, e in enumerate(K.ELEMENTS)
    ]
    return long.groupBy(key).agg(*sums)


def wide_from_array(df: DataFrame, amounts: str, key: str = "row_id") -> DataFrame:
    """Wide form of an array column whose first 32 entries are the element amounts; no shuffle."""
    return df.selectExpr(
        key, *[f"CAST(coalesce(get({amounts}, {i}), 0) AS DOUBLE) AS {e}" for i, e in enumerate(K.ELEMENTS)]
    )


def elements_array() -> Column:
    return F.expr(f"array({', '.join(K.ELEMENTS)})")


def to_long(wide: DataFrame, key: str = "row_id", above: float = 0.0) -> DataFrame:
    """Long form of the wide rows: amounts above the threshold only."""
    return wide.select(key, F.posexplode(elements_array()).alias("elem_idx", "amount")).where(F.col("amount") > above)


def clean_amounts(wide: DataFrame, above: float = 0.0) -> DataFrame:
    """Amounts that count as present; NULL, negative and tiny ones become 0.

    The rule is one function over the array of amounts: 32 conditions beside the sums of an aggregation and the arithmetic that
    follows would make one generated method of more than the 64 KB a method may have. The function ends the aggregation's stage.
    """
    held = F.transform(elements_array(), lambda a: F.when(a > above, a.cast("double")).otherwise(F.lit(0.0)))
    amounts = {e: F.expr(f"coalesce(get({AMOUNTS}, {i}), 0D)") for i, e in enumerate(K.ELEMENTS)}
    others = [c for c in wide.columns if c not in K.ELEMENT_INDEX]
    return wide.select(*others, held.alias(AMOUNTS)).withColumns(amounts).select(*wide.columns)


def with_total(wide: DataFrame, above: float = 0.0) -> DataFrame:
    """Add the amount total over the elements present: amounts above the threshold, all others become 0.

    The presence rule belongs to every composition operator, so it is applied here, where they all begin. The columns
    that result are never NULL, which keeps the generated arithmetic free of null branches; that decides whether it
    fits the size the JIT compiler accepts.
    """
    return clean_amounts(wide, above).withColumn(TOTAL, F.expr(_add(K.ELEMENTS)))


def share_sql(e: str) -> str:
    return f"coalesce(try_divide({e}, {TOTAL}), 0D)"


def share(e: str) -> Column:
    """Molar fraction of one element; 0 for an empty alloy. Needs `with_total`."""
    return F.expr(share_sql(e))


def shares_wide(wide: DataFrame, above: float = 0.0) -> DataFrame:
    """Molar fractions in the element columns; the other columns stay."""
    kept = [c for c in wide.columns if c not in K.ELEMENT_INDEX]
    return with_total(wide, above).select(*kept, *[share(e).alias(e) for e in K.ELEMENTS])


def present_elements(above: float = 0.0) -> Column:
    """(idx, amount) of the elements present, chosen inside the row so that only they become rows."""
    return F.filter(
        F.transform(elements_array(), lambda a, i: F.struct(i.alias("idx"), a.alias("amount"))),
        lambda t: t["amount"] > above,
    )


def fractions(wide: DataFrame, key: str = "row_id", above: float = 0.0) -> DataFrame:
    """Long form with the molar fraction of each element present."""
    return with_total(wide, above).select(key, TOTAL, F.explode(present_elements()).alias("t")).select(
        key, F.col("t.idx").alias("elem_idx"), (F.col("t.amount") / F.col(TOTAL)).alias("fraction")
    )


def element_pairs(wide: DataFrame, key: str = "row_id") -> DataFrame:
    """Pairs of elements present in the same alloy, in element order (at most 32 * 31 / 2 per alloy).

    Built inside the row of the alloy: no self-join, so a long alloy costs no more shuffle than a short one.
    """
    symbols = F.expr("array(" + ", ".join(f"'{e}'" for e in K.ELEMENTS) + ")")
    return (
        wide.select(key, present_elements().alias("right"))
        .select(key, "right", F.explode("right").alias("left"))
        .select(key, "left", F.explode(F.filter("right", lambda t: t["idx"] > F.col("left.idx"))).alias("right"))
        .select(
            key,
            F.get(symbols, F.col("left.idx")).alias("e1"),
            F.get(symbols, F.col("right.idx")).alias("e2"),
            F.col("left.amount").alias("amount1"),
            F.col("right.amount").alias("amount2"),
        )
    )


# --- parameters -------------------------------------------------------------------
# Each builder returns the SQL of one value of the wide row with `amount_total`; an empty alloy gives 0.

def _guard(value: str) -> str:
    return f"coalesce(CASE WHEN {TOTAL} > 0 THEN {value} END, 0D)"


def _scaled_sum(prop: str) -> str:
    return _add([f"{e} * {_num(v)}" for e, v in zip(K.ELEMENTS, K.SCALED[prop], strict=True) if v])


def _mean(prop: str) -> str:
    return _guard(f"{_scaled_sum(prop)} / ({TOTAL} * {_num(K.SCALE[prop])})")


def _spread(prop: str, centre: str) -> str:
    """Weighted population deviation around the scaled mean in column `centre` (second pass over the row)."""
    off = [f"({_num(v)} - {centre})" for v in K.SCALED[prop]]
    squares = _add([f"{e} * ({o} * {o})" for e, o in zip(K.ELEMENTS, off, strict=True)])
    return _guard(f"sqrt({squares} / {TOTAL}) / {_num(K.SCALE[prop])}")


def _size_mismatch(centre: str) -> str:
    """Percent deviation of the atomic radii from the scaled mean radius in column `centre`."""
    off = [f"(1D - coalesce(try_divide({_num(v)}, {centre}), 0D))" for v in K.SCALED["radius"]]
    squares = _add([f"{e} * ({o} * {o})" for e, o in zip(K.ELEMENTS, off, strict=True)])
    return _guard(f"100D * sqrt({squares} / {TOTAL})")


def _entropy() -> str:
    """-R * sum(x ln x), written as R * (ln W - sum(a ln a) / W) to take one division per alloy."""
    terms = _add([f"{e} * coalesce(ln(CASE WHEN {e} > 0 THEN {e} ELSE 1D END), 0D)" for e in K.ELEMENTS])
    return _guard(f"{_num(K.R_GAS)} * (ln({TOTAL}) - {terms} / {TOTAL})")


def _pair_terms() -> list[str]:
    return [f"{a} * {b} * {_num(h)}" for a, b, h in K.PAIRS if h]


def _enthalpy() -> str:
    return _guard(f"4D * {_add(_pair_terms())} / ({TOTAL} * {TOTAL})")


def _enthalpy_spread() -> str:
    """Root of the summed squared pair contributions (not a deviation)."""
    squares = _add([f"({t}) * ({t})" for t in _pair_terms()])
    return _guard(f"4D * sqrt({squares}) / ({TOTAL} * {TOTAL})")


def _density() -> str:
    return f"coalesce(try_divide({_scaled_sum('mass')}, {_scaled_sum('volume')}), 0D)"


def density() -> Column:
    """Mass over volume of the mixture; 0 where there is no volume."""
    return F.expr(_density())


def omega(tm: str = "tm", s: str = "entropy", h: str = "enthalpy") -> Column:
    """Tm * S / |H| with H in J; 0 where the enthalpy is 0."""
    return F.expr(f"CASE WHEN {h} <> 0 THEN {tm} * {s} / (abs({h}) * 1000D) ELSE 0D END")


_SPREAD_OF = {"delta": "radius", "tm_std": "tm", "chi_std": "chi", "vec_std": "vec", "bulk_std": "bulk"}
_MEAN_OF = {"a": "lattice", "tm": "tm", "chi": "chi", "vec": "vec", "bulk": "bulk"}


def with_params(wide: DataFrame, names: Sequence[str] = tuple(K.EMPIRICAL), above: float = 0.0) -> DataFrame:
    """Add parameters by name; only the intermediate columns those need are computed. Amounts that do not count as
    present leave as 0."""
    wanted = set(names) | ({"tm", "entropy", "enthalpy"} if "omega" in names else set())
    centred = [p for n, p in _SPREAD_OF.items() if n in wanted]
    centres = {f"_{p}_centre": F.expr(_guard(f"{_scaled_sum(p)} / {TOTAL}")) for p in centred}
    base = with_total(wide, above)
    base = base.withColumns(centres) if centres else base
    sql = {n: _mean(p) for n, p in _MEAN_OF.items()}
    sql |= {n: _spread(p, f"_{p}_centre") for n, p in _SPREAD_OF.items() if n != "delta"}
    sql |= {"delta": _size_mismatch("_radius_centre"), "entropy": _entropy(), "enthalpy": _enthalpy(),
            "enthalpy_spread": _enthalpy_spread(), "density": _density()}
    out = base.withColumns({n: F.expr(sql[n]) for n in K.EMPIRICAL if n in wanted and n != "omega"})
    if "omega" in names:
        out = out.withColumn("omega", omega())
    return out.select(*wide.columns, *names)


def empirical_params(wide: DataFrame, key: str = "row_id", names: Sequence[str] = tuple(K.EMPIRICAL),
                     above: float = 0.0) -> DataFrame:
    return with_params(wide, names, above).select(key, *names)


def round_params(df: DataFrame, names: Sequence[str] = tuple(K.EMPIRICAL)) -> DataFrame:
    """Storage rounding of the parameters, half-even."""
    return df.withColumns({n: F.bround(n, K.EMPIRICAL_DIGITS.get(n, K.DEFAULT_DIGITS)) for n in names})


def element_totals(long: DataFrame, elem: str = "elem_idx", amount: str = "amount", above: float = 0.0) -> DataFrame:
    """Total amount of each element over all rows in which it is present."""
    counted = F.expr(f"sum(CASE WHEN `{amount}` > {_num(above)} THEN CAST(`{amount}` AS DOUBLE) ELSE 0D END) AS total")
    return known_elements(long, elem).groupBy(elem).agg(counted)


def weighted_means(long: DataFrame, props: Sequence[str] = tuple(K.PROPERTIES), key: str = "row_id",
                   above: float = 0.0) -> DataFrame:
    """Amount-weighted means per alloy. Rows of one element add up before the presence rule looks at them, as in the
    wide form that all other parameters start from; it takes the same single shuffle."""
    return with_total(to_wide(long, key), above).select(key, *[F.expr(_mean(p)).alias(p) for p in props])


def mixture_density(long: DataFrame, key: str = "row_id", above: float = 0.0) -> DataFrame:
    return with_total(to_wide(long, key), above).select(key, density().alias("density"))


def array_density(amounts: Column) -> Column:
    """Density of a dense amount array, as one expression over the array."""
    def dot(p: str) -> Column:
        weights = F.expr(f"array({', '.join(_num(v) for v in K.SCALED[p])})")
        return F.aggregate(F.zip_with(amounts, weights, lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)

    return F.when(dot("volume") > 0, dot("mass") / dot("volume"))


# --- summaries --------------------------------------------------------------------

def present_sql(e: str, threshold: float = K.PRESENT_ABOVE) -> str:
    """1 where the share of an element is above the threshold, written without a division per element."""
    return f"CASE WHEN {e} > {_num(threshold)} * {TOTAL} THEN 1 ELSE 0 END"


def n_elements(threshold: float = K.PRESENT_ABOVE) -> Column:
    return F.expr(_add([present_sql(e, threshold) for e in K.ELEMENTS]))


def max_share_sql() -> str:
    # dividing by one positive total keeps the order, so the largest amount has the largest share
    return f"coalesce(try_divide(greatest({', '.join(K.ELEMENTS)}), {TOTAL}), 0D)"


def max_share() -> Column:
    return F.expr(max_share_sql())


def present_shares(threshold: float = K.PRESENT_ABOVE) -> Column:
    """(elem_idx, share) of the elements above the threshold, renormalised to sum 1. Needs `with_total`."""
    kept = F.filter(
        F.transform(elements_array(), lambda a, i: F.struct(i.alias("elem_idx"), a.alias("amount"))),
        lambda t: t["amount"] > F.lit(threshold) * F.col(TOTAL),
    )
    total = F.aggregate(kept, F.lit(0.0), lambda acc, t: acc + t["amount"])
    # the one-element array binds the total once; named inside the inner lambda it would be summed per element
    shares = F.transform(
        F.array(total),
        lambda w: F.transform(kept, lambda t: F.struct(t["elem_idx"].alias("elem_idx"), (t["amount"] / w).alias("share"))),
    )
    return F.when(F.col(TOTAL) > 0, F.get(shares, F.lit(0)))
