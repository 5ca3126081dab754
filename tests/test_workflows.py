import pytest
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.operators import screen
from meltframe.operators.models import Forest
from meltframe.plans import views as V
from meltframe.plans import workflows as W
from meltframe.session import stored
from meltframe.sources import tables

SF = "/root/testdata/sf0.001"
FOREST = Forest(trees=3, depth=4, bins=16)


@pytest.fixture(scope="module")
def alloys(spark):
    """Alloy table in its source form: corrosion rows without parameters and flags."""
    record = V.noted_record(spark, SF).withColumnRenamed("phrase", "processing_text")
    full = record.join(V.wide(spark, SF), "row_id").withColumns(
        {n: F.lit(0.0) for n in K.EMPIRICAL} | {p: F.lit(0) for p in K.PROCESS_FLAGS}
    ).withColumns({"tm": F.lit(7.0), "process_4": F.lit(1), "composition": F.lit("x")})
    return stored(full.select(*tables.alloy_schema().names))


def test_prepare_completes_only_the_corrosion_rows(alloys):
    ready = stored(W.prepare(alloys))
    assert ready.columns == alloys.columns and ready.count() == alloys.count()
    rows = {r["domain"]: r for r in ready.groupBy("domain").agg(
        F.min("tm").alias("tm"), F.max("tm").alias("tm_max"), F.min("density").alias("density"),
        F.count_if(F.col("process_4") == 1).alias("p4"), F.count("*").alias("n")).collect()}
    assert (rows["mechanical"]["tm"], rows["mechanical"]["tm_max"]) == (7.0, 7.0)
    assert rows["mechanical"]["p4"] == rows["mechanical"]["n"]
    assert rows["corrosion"]["tm"] > 60 and rows["corrosion"]["density"] > 0
    assert 0 < rows["corrosion"]["p4"] < rows["corrosion"]["n"]
    assert ready.select(*K.ELEMENTS).exceptAll(alloys.select(*K.ELEMENTS)).isEmpty()


def test_train_and_screen(spark, alloys):
    inputs = stored(W.model_inputs(W.prepare(alloys)))
    a = W.train_separate(inputs, FOREST, FOREST, folds=2)
    assert {r["property"] for r in a.metrics.collect()} == {K.TARGET_LABELS[t] for t in K.TARGETS}
    assert a.accuracies.count() == 4
    wide = V.wide(spark, SF).withColumn("process_scores", F.array(*[F.lit(float(i)) for i in range(7)]))
    request = screen.ScreenRequest(max_elements=5, objectives=["Hardness", "icorr", "Density"])
    report = W.screen_candidates(wide, a.family, request, "NaCl", 0.6)
    rows = report.collect()
    assert 0 < len(rows) < wide.count()
    assert all(r["n_elements"] <= 5 and r["composition_sum"] == 1.0 for r in rows)
    assert {r["process"] for r in rows} == {"Cryogenic treatments"}


def test_train_imputed(spark, alloys):
    inputs = stored(W.model_inputs(W.prepare(alloys)))
    training, imputer, export = W.train_imputed(inputs, FOREST, FOREST, FOREST, rounds=1, folds=2,
                                                   scored=["hardness", "icorr_log10"])
    assert export.count() == inputs.count()
    assert export.where(" or ".join(f"{t}_imputed is null" for t in K.TARGETS)).isEmpty()
    assert {r["property"] for r in training.metrics.collect()} == {"Hardness (HVN)", "icorr (log10)"}
    low, high = K.CLIP_RULES["ecorr_mv"]
    assert export.where(~F.col("ecorr_mv_imputed").between(low, high)).isEmpty()
    assert set(training.family.phases) == set(K.PHASE_FLAGS) and len(imputer.steps) == 1
