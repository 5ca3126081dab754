"""Candidate screening: generation, dense layers, decoding, constraints and objectives."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.functions import keys, text
from meltframe.operators import composition as comp


@dataclass(frozen=True)
class ScreenRequest:
    """What a screen asks for; checked before any plan is built."""

    allowed: Sequence[str] = field(default_factory=lambda: list(K.ELEMENTS))
    required: Sequence[str] = ()
    max_elements: int = 7
    max_fraction: float = K.MAX_FRACTION
    threshold: float = K.PRESENT_ABOVE
    objectives: Sequence[str] = ("Tensile Strength", "Elongation", "icorr")

    def validate(self) -> ScreenRequest:
        unknown = [e for e in [*self.allowed, *self.required] if e not in K.ELEMENT_INDEX]
        if unknown:
            raise ValueError(f"unknown elements: {unknown}")
        if not self.allowed:
            raise ValueError("the element pool is empty")
        if len(set(self.allowed)) < 2:
            warnings.warn("a pool of one element leaves only the pure metal", stacklevel=2)
        clash = [e for e in self.required if e in self.banned]
        if clash:
            raise ValueError(f"required but banned: {clash}")
        if len(set(self.objectives)) < 2:
            raise ValueError("a front needs two different objectives or more")
        strange = [o for o in self.objectives if o not in K.OBJECTIVES]
        if strange:
            raise ValueError(f"unknown objectives: {strange}")
        return self

    @property
    def banned(self) -> list[str]:
        return [e for e in K.ELEMENTS if e not in set(self.allowed)]

    @property
    def required_indices(self) -> list[int]:
        return [K.ELEMENT_INDEX[e] for e in self.required]


def banned_complement(props: DataFrame, allowed: DataFrame) -> DataFrame:
    """Elements outside the allowed pool (both tables have at most one row per element)."""
    return props.join(F.broadcast(allowed), "elem", "left_anti").select("elem_idx", "elem")


# --- candidates ---------------------------------------------------------------------

def latent_candidates(df: DataFrame, key: str, size: int = 10, low: float = -3.0, high: float = 3.0,
                      seed: int = 2) -> DataFrame:
    """One latent vector per key, uniform in [low, high), decided by the key alone."""
    return df.select(
        key, F.array(*[keys.uniform(F.col(key), f"{seed}:{i}", low, high) for i in range(size)]).alias("latent")
    )


def layer_weights(table: DataFrame, widths: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Dense layers from rows (layer, unit, input, weight); input -1 is the bias.

    `widths` declares the network, inputs first: (10, 39, 39) has two layers. The table must hold exactly one row per
    weight and bias of it, so what is read is as large as the declared network and nothing is filled in unseen.
    """
    cells = {(k, u, i) for k, (n, m) in enumerate(pairwise(widths)) for u in range(m) for i in range(-1, n)}
    rows = table.select("layer", "unit", "input", "weight").limit(len(cells) + 1).collect()
    given = {(r["layer"], r["unit"], r["input"]): float("nan") if r["weight"] is None else r["weight"] for r in rows}
    if len(rows) != len(cells) or set(given) != cells or any(np.isnan(list(given.values()))):
        raise ValueError(f"{len(cells)} weights are declared, one row each; missing: {sorted(cells - set(given))[:3]}, "
                         f"unknown: {sorted(set(given) - cells, key=str)[:3]}, rows: {len(rows)}")
    layers = []
    for k, (n, m) in enumerate(pairwise(widths)):
        full = np.array([[given[k, u, i] for i in range(-1, n)] for u in range(m)], float).reshape(m, n + 1)
        layers.append((full[:, 1:], full[:, 0]))
    return layers


def dense_relu(df: DataFrame, vector: str, layers: Sequence[tuple[np.ndarray, np.ndarray]], key: str = "row_id",
               out: str = "raw") -> DataFrame:
    """Dense layers with ReLU over a vector column, one matrix product per Arrow batch."""
    width = layers[0][0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            for matrix, bias in layers:
                x = np.maximum(x @ matrix.T + bias, 0.0)
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[key, out]
            )

    key_type = df.schema[key].dataType.simpleString()
    # a vector of another length, or with a hole, would shift its neighbours: fail on it instead
    vec = F.transform(vector, lambda v: v.cast("double"))
    sound = (F.size(vec) == width) & ~F.exists(vec, lambda v: v.isNull())
    checked = F.when(sound, vec).otherwise(F.raise_error(F.lit(f"{vector} needs {width} numbers")))
    return df.select(key, checked.alias("vec")).mapInArrow(run, f"{key} {key_type}, {out} array<double>")


def decode(df: DataFrame, bounds: DataFrame, raw: str = "raw", key: str = "row_id") -> DataFrame:
    """Wide amounts raw * high + low from the first 32 entries; the other entries stay as process scores.

    `bounds` is a single row (see `profile.bounds_row`) and is read as a scalar subquery.
    """
    limits = bounds.select(F.struct("low", "high")).scalar()
    held = df.select(key, F.col(raw), limits.alias("_b"))
    amounts = [f"get({raw}, {i}) * get(_b.high, {i}) + get(_b.low, {i}) AS {e}" for i, e in enumerate(K.ELEMENTS)]
    return held.selectExpr(key, *amounts, f"slice({raw}, 33, 7) AS process_scores")


# --- constraints ---------------------------------------------------------------------

def violations(wide: DataFrame, request: ScreenRequest) -> DataFrame:
    """One violation column per constraint (<= 0 holds), `total_violation` and `feasible`, in the row of
    the candidate. An empty candidate is infeasible."""
    request.validate()
    limit = f"{request.threshold!r}D"
    count = " + ".join(comp.present_sql(e, request.threshold) for e in K.ELEMENTS)
    cols = {"v_max_elements": f"CAST({count} - {request.max_elements} AS DOUBLE)"}
    cols |= {f"v_banned_{e}": f"{comp.share_sql(e)} - {limit}" for e in request.banned}
    cols |= {f"v_required_{e}": f"{limit} - {comp.share_sql(e)}" for e in request.required}
    cols["v_max_fraction"] = f"{comp.max_share_sql()} - {request.max_fraction!r}D"
    out = comp.with_total(wide).withColumns({n: F.expr(sql) for n, sql in cols.items()})
    return out.withColumns({
        "total_violation": F.expr(" + ".join(f"greatest({c}, 0D)" for c in cols)),
        "feasible": F.expr(" AND ".join(f"{c} <= 0" for c in cols) + f" AND {comp.TOTAL} > 0"),
    })


def violation_columns(request: ScreenRequest) -> list[str]:
    return ["v_max_elements", *[f"v_banned_{e}" for e in request.banned],
            *[f"v_required_{e}" for e in request.required], "v_max_fraction"]


def banned_string_filter(df: DataFrame, banned: Sequence[str], col: str = "composition",
                         threshold: float = K.PRESENT_ABOVE) -> DataFrame:
    """Drop rows whose composition string holds a banned element above the threshold.

    The string is parsed, so a banned `C` does not look at `Co` or `Cr`.

    The verdict is the output of a generator (one row for each): a plain filter is pushed below the projection that builds the
    string, with a copy of all of its arithmetic, sums within sums, wherever the condition names the column.
    """
    if not banned:
        return df
    offends = F.exists(
        text.parse_composition(F.col(col)), lambda t: t["elem"].isin(list(banned)) & (t["share"] > threshold)
    )
    verdict = "_stays"
    while verdict in df.columns:
        verdict = f"_{verdict}"
    judged = df.select("*", F.explode(F.array(~F.coalesce(offends, F.lit(False)))).alias(verdict))
    return judged.where(F.col(verdict)).drop(verdict)


# --- objectives ----------------------------------------------------------------------

def objective_matrix(df: DataFrame, objectives: Sequence[str], key: str = "row_id",
                     columns: dict[str, str] | None = None) -> DataFrame:
    """One column per objective, all to be minimised: maximised ones change sign."""
    sources = {o: K.OBJECTIVES[o][2] for o in objectives} | (columns or {})
    cols = []
    for o in objectives:
        value = F.col(sources[o]).cast("double")
        signed = F.lit(0.0) - value if K.OBJECTIVES[o][0] == "maximize" else value
        cols.append(signed.alias(objective_column(o)))
    return df.select(key, *cols)


def objective_column(name: str) -> str:
    return "f_" + name.lower().replace(" ", "_")


# Which views a front gets: (group of x, group of y, title). Within one group the first two objectives are shown; a view of
# two groups shows the first of each; the last rule pairs every ungrouped objective with the first one, and titles itself.
VIEW_RULES = [
    ("mechanical", "mechanical", "Mechanical"), ("mechanical", "corrosion", "Mech vs Corrosion"),
    ("corrosion", "corrosion", "Corrosion"), ("first", "other", None),
]


def front_pairs(objectives: Sequence[str]) -> list[tuple[str, str, str]]:
    """(x, y, title) of the objective pairs worth viewing for a selection of objectives."""
    group_of = dict.fromkeys(K.MECH_OBJECTIVES, "mechanical") | dict.fromkeys(K.CORR_OBJECTIVES, "corrosion")
    groups: dict[str, list[str]] = {"mechanical": [], "corrosion": [], "other": []}
    for o in objectives:
        groups[group_of.get(o, "other")].append(o)
    groups["first"] = [*groups["mechanical"], *groups["corrosion"], *groups["other"]][:1]
    views = []
    for left, right, title in VIEW_RULES:
        pairs = [(x, y) for x in groups[left] for y in groups[right] if x != y]
        views += [(x, y, title or f"{x} vs {y}") for x, y in (pairs[:1] if title else pairs)]
    return views


def front_views(df: DataFrame, pairs: Sequence[tuple[str, str, str]], columns: dict[str, str],
                key: str = "row_id") -> DataFrame:
    """The points of every pair view in long form: one scan, one row per point and view."""
    views = [
        F.struct(F.lit(title).alias("title"), F.lit(x).alias("x_name"), F.lit(y).alias("y_name"),
                 F.col(columns[x]).cast("double").alias("x"), F.col(columns[y]).cast("double").alias("y"))
        for x, y, title in pairs
    ]
    return df.select(key, F.inline(F.array(*views)))
