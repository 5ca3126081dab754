import pytest
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.operators import composition as comp

GOLDEN = """
CoCrFeMnNi 4.138 1.054571 1801.2 214.32816 13.380867 -3.2 1.879574 7.531755 1.766 0.138362 8.0 1.414214 162.0 22.271057 8.02777
AlCoCrFeNi 3.166 5.437823 1684.0 408.690103 13.380867 -12.16 5.392736 1.853074 1.778 0.120565 7.2 2.481935 153.2 39.305979 6.717669
Al0.5CoCrFeNi 3.067778 4.384558 1767.444444 340.523816 13.145213 -8.888889 3.623494 2.613761 1.796667 0.112546 7.666667 2.160247 161.777778 31.318357 7.334561
HfNbTaTiZr 3.198 5.039174 2523.0 476.414945 13.380867 -0.32 0.96 105.499772 1.454 0.118254 4.4 0.489898 136.8 40.901834 9.89361
Al 4.05 0 933 0 0 0 0 0 1.61 0 3 0 76 0 2.698
TiZr 3.09 4.234528 2034.5 93.5 5.762826 0 0 0 1.435 0.105 4 0 102 8 5.640308
AgCu 3.855 5.882353 1296.5 61.5 5.762826 0 0 0 1.915 0.015 11 0 120 20 9.863061
"""
RECIPES = {
    "CoCrFeMnNi": {e: 1.0 for e in ("Co", "Cr", "Fe", "Mn", "Ni")},
    "AlCoCrFeNi": {e: 1.0 for e in ("Al", "Co", "Cr", "Fe", "Ni")},
    "Al0.5CoCrFeNi": {"Al": 0.5, "Co": 1.0, "Cr": 1.0, "Fe": 1.0, "Ni": 1.0},
    "HfNbTaTiZr": {e: 1.0 for e in ("Hf", "Nb", "Ta", "Ti", "Zr")},
    "Al": {"Al": 1.0},
    "TiZr": {"Ti": 1.0, "Zr": 1.0},
    "AgCu": {"Ag": 1.0, "Cu": 1.0},
}


def long_table(spark, recipes, scale=1.0, order=1):
    rows = [(n, K.ELEMENT_INDEX[e], v * scale) for n, r in recipes.items() for e, v in list(r.items())[::order]]
    return spark.createDataFrame(rows, "row_id string, elem_idx int, amount double")


def params(spark, **options):
    out = comp.empirical_params(comp.to_wide(long_table(spark, RECIPES, **options)))
    return {r["row_id"]: [r[n] for n in K.EMPIRICAL] for r in out.collect()}


def test_golden_rows(spark):
    got = params(spark)
    for line in GOLDEN.strip().split("\n"):
        name, *expected = line.split()
        assert got[name] == pytest.approx([float(v) for v in expected], abs=1e-5, rel=1e-6), name


def test_scale_and_order_do_not_matter(spark):
    base = params(spark)
    for options in ({"scale": 37.5}, {"order": -1}):
        for name, values in params(spark, **options).items():
            assert values == pytest.approx(base[name], abs=1e-9)


def test_empty_alloy_is_all_zero(spark):
    wide = comp.to_wide(spark.createDataFrame([("x", 1, 0.0)], "row_id string, elem_idx int, amount double"))
    row = comp.empirical_params(wide).first()
    assert [row[n] for n in K.EMPIRICAL] == [0.0] * 15


def test_negative_and_missing_amounts_are_absent(spark):
    wide = comp.to_wide(long_table(spark, {"x": {"Al": 1.0}}))
    dirty = wide.withColumns({"Fe": F.lit(-3.0), "Co": F.lit(None).cast("double"), "Ni": F.lit(1e-7)})
    clean = comp.clean_amounts(dirty, above=1e-6)
    row = comp.empirical_params(clean, names=["tm", "density"]).first()
    assert row["tm"] == 933.0 and row["density"] == pytest.approx(2.698)


def test_presence_rule_is_part_of_every_operator(spark):
    long = spark.createDataFrame([("x", 1, 2.0), ("x", 8, -1.0), ("x", 3, None)], "row_id string, elem_idx int, amount double")
    assert [(r["elem_idx"], r["fraction"]) for r in comp.fractions(comp.to_wide(long)).collect()] == [(1, 1.0)]
    assert comp.weighted_means(long, ["tm"]).first()["tm"] == comp.empirical_params(comp.to_wide(long)).first()["tm"] == 933.0
    assert comp.mixture_density(long).first()["density"] == pytest.approx(2.698)
    low = spark.createDataFrame([("x", 1, 2.0), ("x", 8, 0.001)], "row_id string, elem_idx int, amount double")
    assert comp.fractions(comp.to_wide(low), above=0.01).count() == 1 and comp.fractions(comp.to_wide(low)).count() == 2


def test_unknown_elements_fail(spark):
    for index in (40, -1, None):
        long = spark.createDataFrame([("x", 1, 2.0), ("x", index, 1.0)], "row_id string, elem_idx int, amount double")
        with pytest.raises(Exception, match="unknown element index"):
            comp.to_wide(long).collect()


def test_forms_agree(spark):
    wide = comp.to_wide(long_table(spark, RECIPES))
    back = comp.to_wide(comp.to_long(wide))
    assert wide.exceptAll(back).count() == 0
    shares = comp.fractions(wide).groupBy("row_id").agg(F.sum("fraction").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in shares)


def test_grouped_sums_match_the_row_form(spark):
    long = long_table(spark, RECIPES)
    by_sum = {r["row_id"]: r["tm"] for r in comp.weighted_means(long).collect()}
    by_row = {r["row_id"]: r["tm"] for r in comp.empirical_params(comp.to_wide(long)).collect()}
    assert by_sum == pytest.approx(by_row)


def test_pairs_and_their_enthalpies(spark):
    wide = comp.to_wide(long_table(spark, {"x": {"Ti": 1.0, "Al": 2.0, "Ag": 1.0}}))
    rows = comp.pair_lookup(comp.element_pairs(wide), comp.pair_table(spark)).collect()
    assert {(r["e1"], r["e2"]): r["h"] for r in rows} == {("Ag", "Al"): 0.0, ("Ag", "Ti"): 0.0, ("Al", "Ti"): -30.0}


def test_one_alloy_holding_a_third_of_all_rows(spark):
    """Repeated rows of one alloy combine before the shuffle: whole result, one row, one shuffle."""
    long = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("row_id"),
        (F.col("id") % 32).cast("int").alias("elem_idx"), F.lit(2).cast("bigint").alias("amount"),
    )
    wide = comp.to_wide(long)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    hot = wide.where("row_id = -1").select(F.expr(" + ".join(K.ELEMENTS)).alias("total")).collect()
    assert [r["total"] for r in hot] == [20000.0]
    assert wide.count() == 20001


def test_parameters_compile(spark):
    """No stage of the parameters is too large for the generated code of one method."""
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert len(params(spark)) == len(RECIPES)
        odd = spark.createDataFrame([("x", 1, None), ("x", 2, -3.0), ("x", 3, 2.0)], "row_id string, elem_idx int, amount double")
        row = comp.clean_amounts(comp.to_wide(odd)).first()
        assert row["row_id"] == "x" and [row[e] for e in K.ELEMENTS] == [2.0 if i == 3 else 0.0 for i in range(len(K.ELEMENTS))]
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
