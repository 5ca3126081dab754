import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.operators import composition as comp
from meltframe.operators import impute, models, report
from meltframe.operators.models import Forest
from meltframe.session import stored

FOREST = Forest(trees=4, depth=5, bins=16)


@pytest.fixture(scope="module")
def table(spark):
    from meltframe.plans.views import feature_table
    from meltframe.session import stored

    return stored(feature_table(spark, "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def simple(spark):
    g = np.random.default_rng(0)
    x = g.random((600, 3))
    label = 10 * x[:, 0] + 3 * x[:, 1] ** 2
    return spark.createDataFrame(
        [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, label))],
        "row_id long, p double, q double, r double, label double")


def test_cross_validation_learns_and_covers_all_rows(simple):
    guesses = models.cross_predict(simple, "label", ["p", "q", "r"], forest=Forest(trees=20, depth=8, bins=64))
    assert guesses.count() == 600 and guesses.select("row_id").distinct().count() == 600
    from meltframe.operators.evaluate import r2_score

    assert min(r["r2"] for r in r2_score(guesses, "truth", "guess", ["fold"]).collect()) > 0.9


def test_same_layout_same_forest(simple):
    def run(df):
        model = models.fit_regressor(df, "label", ["p", "q", "r"], FOREST)
        return [r["guess"] for r in models.predict(simple, {"guess": model}, ["p", "q", "r"]).orderBy("row_id").collect()]

    assert run(simple) == run(simple.repartition(7, "q"))


def test_fits_share_one_layout_that_grows_with_the_rows(simple, monkeypatch):
    names = ["p", "q", "r"]
    table = stored(simple)
    with models.laid_out(table, FOREST) as (laid, at_once):
        rows = models.training_rows(laid, "label", names, FOREST, "row_id", True)
        assert at_once == 4 and rows.rdd.getNumPartitions() == FOREST.partitions
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan
        shared = models.grow_regressor(rows, FOREST)
    own = models.fit_regressor(table, "label", names, FOREST)
    assert shared.toDebugString.split("\n")[1:] == own.toDebugString.split("\n")[1:]
    monkeypatch.setattr(models, "LAYOUT_ROWS", (20, 20))
    monkeypatch.setattr(models, "ROWS_AT_ONCE", 1200)
    with models.laid_out(table, FOREST) as (laid, at_once):
        assert at_once == 2 and laid.rdd.getNumPartitions() == 30
    assert not table.storageLevel.useDisk


def test_feature_table_moves_only_what_a_record_is_made_of(spark):
    from meltframe.plans.views import feature_table

    plan = feature_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    joined = plan.toString().split("Join LeftOuter, (o_orderkey")[1]
    assert "domain" not in joined and "electrolyte" not in joined


def test_imputer_keeps_observed_cells_and_fills_the_rest(spark, simple, tmp_path):
    holes = simple.withColumns({
        "label": F.when(F.col("row_id") % 4 != 0, F.col("label")), "q": F.when(F.col("row_id") % 9 != 0, F.col("q"))})
    imputer = impute.ChainedImputer(["p", "q", "r", "label"], rounds=2, forest=Forest(trees=10, depth=8, bins=64))
    model, filled = imputer.fit_transform(holes)
    assert [c for c, _ in model.steps[0]] == ["q", "label"]  # fewest gaps first
    joined = filled.join(holes.select("row_id", F.col("label").alias("seen"), F.col("q").alias("seen_q")), "row_id").join(
        simple.select("row_id", F.col("label").alias("true")), "row_id").collect()
    assert len(joined) == 600
    assert all(r["label"] is not None and r["q"] is not None for r in joined)
    assert all(r["seen"] in (None, r["label"]) and r["seen_q"] in (None, r["q"]) for r in joined)
    gap = [(r["label"], r["true"]) for r in joined if r["seen"] is None]
    error = np.mean([(a - b) ** 2 for a, b in gap])
    assert error < 0.2 * np.var([b for _, b in gap])
    # replaying the fitted rounds on the same rows gives the same cells, also after a round trip to disk
    model.save(spark, str(tmp_path / "imputer"))
    for m in (model, impute.ImputerModel.load(spark, str(tmp_path / "imputer"))):
        again = {r["row_id"]: r["label"] for r in m.transform(holes).collect()}
        assert again == {r["row_id"]: r["label"] for r in filled.collect()}


def test_imputer_moves_the_rows_once_a_round(spark, simple, monkeypatch):
    holes = simple.withColumns({c: F.when(F.col("row_id") % n != 0, F.col(c)) for c, n in (("p", 7), ("q", 9), ("label", 4))})
    laid, given = [], models.stable_layout
    monkeypatch.setattr(models, "stable_layout", lambda *args: laid.append(args[-1]) or given(*args))
    model, filled = impute.ChainedImputer(["p", "q", "r", "label"], rounds=2, tolerance=0.0, forest=FOREST).fit_transform(holes)
    assert [len(step) for step in model.steps] == [3, 3] and laid == [600, 600]
    assert filled.count() == 600 and not spark.sparkContext._jsc.getPersistentRDDs()


def test_family_round_trip_and_two_stage_scores(spark, table, tmp_path):
    vectors = models.with_vectors(table)
    specs = [s for s in models.family_a("features_58", "features_66") if s.target in ("hardness", "icorr_log10")]
    family = models.Family(models.train_family(vectors, specs, FOREST), models.train_phases(vectors, FOREST, "features_58"))
    family.save(str(tmp_path / "family"))
    loaded = models.Family.load(str(tmp_path / "family"))
    cols = ["row_id", "hardness", "icorr_log10", *K.PHASE_FLAGS, *[f"{p}_probability" for p in K.PHASE_FLAGS]]
    a = models.two_stage_score(table, family).select(cols).orderBy("row_id").collect()
    b = models.two_stage_score(table, loaded).select(cols).orderBy("row_id").collect()
    assert a == b and len(a) == table.count()
    low, high = table.agg(F.min("hardness"), F.max("hardness")).first()
    assert all(low <= r["hardness"] <= high for r in a)
    assert all(0 <= r["fcc_probability"] <= 1 and r["fcc"] in (0.0, 1.0) for r in a)
    assert (tmp_path / "family" / "feature_config").exists()


def test_family_of_the_imputed_kind_round_trip(spark, table, tmp_path):
    """Its mechanical models split on the environment too, so the feature list has to travel with them."""
    specs = [s for s in models.family_b() if s.target == "hardness"]
    family = models.Family(models.train_family(table, specs, FOREST), models.train_phases(table, FOREST), K.CORR_FEATURES)
    family.save(str(tmp_path / "b"))
    loaded = models.Family.load(str(tmp_path / "b"))
    assert loaded.mech_features == list(K.CORR_FEATURES)
    a, b = [models.two_stage_score(table, f).select("row_id", "hardness").orderBy("row_id").collect() for f in (family, loaded)]
    assert a == b


def test_vectors_with_other_features_are_refused_by_name(spark, table, tmp_path):
    vectors = models.with_vectors(table)
    specs = [s for s in models.family_a("features_58", "features_66") if s.target in ("hardness", "icorr_log10")]
    family = models.Family(models.train_family(vectors, specs, FOREST), models.train_phases(vectors, FOREST, "features_58"))
    stored_vectors = stored(vectors)  # names survive Parquet
    assert models.feature_names(stored_vectors, "features_58") == K.MECH_FEATURES
    got = family.score_vectors(stored_vectors.drop("hardness", "icorr_log10"))
    assert got.count() == table.count() and got.where("hardness is null or icorr_log10 is null").isEmpty()
    swapped = [*K.MECH_FEATURES[1::-1], *K.MECH_FEATURES[2:]]
    filled = table.na.fill(0.0, [c for c in K.CORR_FEATURES])
    for names, said in ((swapped, f"moved: {K.MECH_FEATURES[0]}, {K.MECH_FEATURES[1]}"), (K.MECH_FEATURES[:-1], f"missing: {K.MECH_FEATURES[-1]}")):
        other = models.assemble(filled, names, "v")
        with pytest.raises(models.FeatureMismatch, match=said):
            models.require_features(other, "v", K.MECH_FEATURES)
    bare = stored_vectors.withMetadata("features_58", {})
    assert models.feature_names(bare, "features_58") is None
    assert models.require_features(bare, "features_58", K.MECH_FEATURES).select("features_58").count() == table.count()
    with pytest.raises(Exception, match="58 features for 57"):
        models.require_features(bare, "features_58", K.MECH_FEATURES[1:]).select("features_58").collect()
    named = models.with_feature_names(bare, "features_58", K.MECH_FEATURES)
    assert models.require_features(named, "features_58", K.MECH_FEATURES).columns == named.columns
    path = str(tmp_path / "f")
    family.save(path)
    spark.createDataFrame([(swapped, K.CORR_FEATURES)], "mech_features array<string>, corr_features array<string>").write.mode(
        "overwrite").json(f"{path}/feature_config")
    with pytest.raises(models.FeatureMismatch, match="mech_features: moved"):
        models.Family.load(path)


def test_imputer_as_a_pipeline_stage(spark, simple, tmp_path):
    holes = simple.withColumn("q", F.when(F.col("row_id") % 9 != 0, F.col("q")))
    imputer = impute.ForestImputer(inputCols=["p", "q", "r"], rounds=2, numTrees=4, maxDepth=5, maxBins=16, seed=3)
    pipeline = Pipeline(stages=[imputer, VectorAssembler(inputCols=["p", "q", "r"], outputCol="x"),
                                RandomForestRegressor(featuresCol="x", labelCol="label", numTrees=4, maxDepth=5, seed=1)])
    pipeline.write().overwrite().save(str(tmp_path / "plan"))
    again = Pipeline.load(str(tmp_path / "plan")).getStages()[0]
    assert again.extractParamMap().keys() == imputer.extractParamMap().keys() and again.getOrDefault("numTrees") == 4
    assert imputer.copy({imputer.rounds: 1}).getOrDefault("rounds") == 1 and imputer.getOrDefault("rounds") == 2
    fitted = pipeline.fit(holes)
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    assert loaded.stages[0].uid == fitted.stages[0].uid and loaded.stages[0].getOrDefault("maxDepth") == 5

    def run(model):
        return [tuple(r) for r in model.transform(holes).select("row_id", "q", "prediction").orderBy("row_id").collect()]

    rows = run(fitted)
    assert run(loaded) == rows and len(rows) == 600 and all(q is not None for _, q, _ in rows)
    plain = impute.ChainedImputer(["p", "q", "r"], rounds=2, forest=Forest(trees=4, depth=5, bins=16, seed=3)).fit_transform(holes)[1]
    assert [q for _, q, _ in rows] == [r["q"] for r in plain.orderBy("row_id").collect()]


def test_imputer_leaves_an_empty_column_and_an_empty_table(spark, simple):
    holes = simple.withColumns({"q": F.when(F.col("row_id") % 9 != 0, F.col("q")), "none": F.lit(None).cast("double")})
    imputer = impute.ChainedImputer(["p", "q", "none"], rounds=2, forest=FOREST)
    model, filled = imputer.fit_transform(holes)
    assert [c for c, _ in model.steps[0]] == ["q"]
    assert filled.where("none is not null or q is null").isEmpty() and filled.count() == 600
    assert model.transform(holes).where("none is not null or q is null").isEmpty()
    assert imputer.fit_transform(holes.where("false"))[1].isEmpty()


def test_forest_does_not_follow_the_session(spark, simple):
    def run(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        model = models.fit_regressor(simple, "label", ["p", "q", "r"], FOREST)
        return models.predict(simple, {"guess": model}, ["p", "q", "r"]).agg(F.sum("guess")).first()[0]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert run("8") == pytest.approx(run("5"), abs=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_honest_classifier_does_not_see_its_label(table):
    with_label = models.train_phases(table, FOREST)["fcc"]
    honest = models.train_phases(table, FOREST, include_phase=False)["fcc"]
    at = K.MECH_FEATURES.index("fcc")
    assert with_label.featureImportances[at] > 0.2 and honest.featureImportances[at] == 0.0


def test_holdout_accuracy(table):
    _, score = models.holdout_accuracy(table, "bcc", list(K.MECH_FEATURES), FOREST)
    row = score.first()
    assert row["phase"] == "bcc" and 0.5 < row["accuracy"] <= 1.0 and row["n"] > 50


def test_nested_cv_uses_real_targets(table):
    guesses = impute.nested_cv(table, ["hardness"], features=["tm", "density", "bulk"],
                               folds=2, rounds=1, forest=FOREST, imputer_forest=FOREST)
    truth = table.where((F.col("domain") == "mechanical") & F.col("hardness").isNotNull())
    assert guesses.count() == truth.count()
    lost = guesses.join(truth.select("row_id", "hardness"), "row_id").where(
        F.col("truth") != F.least(F.col("hardness"), F.lit(3000.0)))
    assert lost.count() == 0


def test_screen_report_columns(spark):
    base = comp.to_wide(spark.createDataFrame([(1, 1, 1.0), (1, 8, 1.0), (1, 3, 0.001)],
                                              "row_id int, elem_idx int, amount double"))
    values = {t: F.lit(10.0) for t in K.MECH_TARGETS + ["ecorr_mv", "epit_mv"]} | {"icorr_log10": F.lit(-2.0)}
    values |= {p: F.lit(0.0) for p in K.PHASE_FLAGS} | {f"{p}_probability": F.lit(0.25) for p in K.PHASE_FLAGS}
    scored = base.withColumns({**values, "process_scores": F.array(*[F.lit(float(i == 3)) for i in range(7)])})
    out = report.screen_report(scored)
    row = out.first()
    assert (row["composition"], row["n_elements"], row["process"]) == ("Al0.500Fe0.500", 2, "Powder metallurgy")
    assert (row["phase"], row["icorr"], row["al_fraction"], row["composition_sum"]) == ("FCC (dominant)", 0.01, 0.5, 1.0)
    assert len(report.report_display(out, hide=False).columns) == 18
    assert len(report.report_display(out).columns) == 11
