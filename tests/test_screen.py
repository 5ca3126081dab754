import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.functions import text
from meltframe.operators import composition as comp
from meltframe.operators import profile, screen


def wide_of(spark, recipes):
    rows = [(n, K.ELEMENT_INDEX[e], float(v)) for n, r in recipes.items() for e, v in r.items()]
    return comp.to_wide(spark.createDataFrame(rows, "row_id string, elem_idx int, amount double"))


def test_request_checks():
    with pytest.raises(ValueError, match="pool is empty"):
        screen.ScreenRequest(allowed=[]).validate()
    with pytest.raises(ValueError, match="required but banned"):
        screen.ScreenRequest(allowed=["Al", "Fe"], required=["Ni"]).validate()
    with pytest.raises(ValueError, match="two different objectives"):
        screen.ScreenRequest(objectives=["Density"]).validate()
    with pytest.raises(ValueError, match="unknown"):
        screen.ScreenRequest(required=["Xx"]).validate()
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        screen.ScreenRequest(allowed=["Al"]).validate()
    assert len(seen) == 1
    assert len(screen.ScreenRequest(allowed=["Al", "Fe"]).banned) == 30


def test_violations(spark):
    wide = wide_of(spark, {
        "good": {"Al": 1, "Fe": 1, "Ni": 1}, "banned": {"Al": 1, "Fe": 1, "Ca": 1}, "missing": {"Fe": 1, "Ni": 1},
        "large": {"Al": 9, "Fe": 1}, "many": {"Al": 1, "Fe": 1, "Ni": 1, "Co": 1}, "empty": {"Al": 0},
    })
    request = screen.ScreenRequest(allowed=[e for e in K.ELEMENTS if e != "Ca"], required=["Al"], max_elements=3)
    rows = {r["row_id"]: r for r in screen.violations(wide, request).collect()}
    assert {n for n, r in rows.items() if r["feasible"]} == {"good"}
    assert rows["many"]["v_max_elements"] == 1.0
    assert rows["banned"]["v_banned_Ca"] == pytest.approx(1 / 3 - 0.005)
    assert rows["missing"]["v_required_Al"] == 0.005
    assert rows["large"]["v_max_fraction"] == pytest.approx(0.3)
    assert rows["good"]["total_violation"] == 0.0
    # more of a banned element never lowers its violation
    more = wide_of(spark, {str(i): {"Al": 5, "Ca": i} for i in range(1, 6)})
    seen = [r["v_banned_Ca"] for r in screen.violations(more, request).orderBy("row_id").collect()]
    assert seen == sorted(seen)


def test_banned_string_filter_builds_the_string_once(spark):
    wide = wide_of(spark, {"clean": {"Al": 1, "Co": 1}, "banned": {"Al": 1, "C": 1}, "trace": {"Al": 999, "C": 1}, "empty": {"Al": 0}})
    strings = comp.with_total(wide).select("row_id", text.composition_string(comp.present_shares()).alias("composition"))
    out = screen.banned_string_filter(strings, ["C", "N"])
    assert out.columns == ["row_id", "composition"]
    assert {r["row_id"]: r["composition"] for r in out.collect()} == {
        "clean": "Al0.500Co0.500", "trace": "Al1.000", "empty": None}
    # pushed below the projection, the condition would hold the whole arithmetic of the string again
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_join(") == 1


def test_dense_layers_match_numpy(spark):
    g = np.random.default_rng(5)
    shapes = [(39, 10), (39, 39), (39, 39)]
    layers = [(g.normal(size=s), g.normal(size=s[0])) for s in shapes]
    rows = [(k, u, i, float(m[u, i]) if i >= 0 else float(b[u])) for k, (m, b) in enumerate(layers)
            for u in range(m.shape[0]) for i in range(-1, m.shape[1])]
    table = spark.createDataFrame(rows, "layer int, unit int, input int, weight double")
    x = g.uniform(-3, 3, (50, 10))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, latent array<double>")
    out = screen.dense_relu(df, "latent", screen.layer_weights(table, (10, 39, 39, 39))).orderBy("row_id").collect()
    for m, b in layers:
        x = np.maximum(x @ m.T + b, 0)
    assert np.allclose([r["raw"] for r in out], x)
    short = spark.createDataFrame([(1, [1.0, 2.0])], "row_id long, latent array<double>")
    with pytest.raises(Exception, match="needs 10 numbers"):
        screen.dense_relu(short, "latent", layers).collect()


def test_weights_must_be_complete_and_unique(spark):
    rows = [(0, u, i, 0.5) for u in range(2) for i in range(-1, 3)]

    def read(given):
        return screen.layer_weights(spark.createDataFrame(given, "layer int, unit int, input int, weight double"), (3, 2))

    (matrix, bias), = read(rows)
    assert matrix.shape == (2, 3) and bias.tolist() == [0.5, 0.5]
    for wrong in (rows[1:], [*rows, rows[0]], [*rows[1:], (0, 0, 7, 1.0)], [*rows[1:], (*rows[0][:3], None)], []):
        with pytest.raises(ValueError, match="8 weights are declared"):
            read(wrong)


def test_candidates_follow_the_key_alone(spark):
    a = screen.latent_candidates(spark.range(100), "id").orderBy("id").collect()
    b = screen.latent_candidates(spark.range(100).repartition(7), "id").orderBy("id").collect()
    assert a == b
    values = np.array([r["latent"] for r in a])
    assert values.min() >= -3 and values.max() < 3 and abs(values.mean()) < 0.3


def test_decode_uses_high_and_low(spark):
    bounds = profile.bounds_row(wide_of(spark, {"x": {"Al": 2, "Fe": 1}, "y": {"Al": 5}}))
    raw = spark.createDataFrame([(1, [0.5] * 32 + [float(i) for i in range(7)])], "row_id long, raw array<double>")
    row = screen.decode(raw, bounds).first()
    assert (row["Al"], row["Fe"], row["Ni"]) == (0.5 * 5 + 2, 0.5, 0.0)
    assert row["process_scores"] == [float(i) for i in range(7)]


def test_objectives_are_minimised(spark):
    df = spark.createDataFrame([(1, 100.0, 7.0)], "row_id long, hardness double, density double")
    row = screen.objective_matrix(df, ["Hardness", "Density"]).first()
    assert (row["f_hardness"], row["f_density"]) == (-100.0, 7.0)


def test_front_pairs():
    assert screen.front_pairs(["Hardness", "Elongation", "icorr", "Density"]) == [
        ("Hardness", "Elongation", "Mechanical"), ("Hardness", "icorr", "Mech vs Corrosion"),
        ("Hardness", "Density", "Hardness vs Density")]
    assert screen.front_pairs(["Density", "FCC"]) == [("Density", "FCC", "Density vs FCC")]
    assert screen.front_pairs(["Ecorr", "Epit"]) == [("Ecorr", "Epit", "Corrosion")]
    assert screen.front_pairs(["Density"]) == []
