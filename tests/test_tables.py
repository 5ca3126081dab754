import json
from functools import partial

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meltframe import constants as K
from meltframe.functions import columns as C
from meltframe.operators import evaluate, impute, profile, report, split
from meltframe.session import together
from meltframe.sources import tables


def test_versions_never_overwrite_what_is_read(spark, tmp_path):
    base = str(tmp_path / "alloys")
    with pytest.raises(FileNotFoundError):
        tables.read_latest(spark, base)
    tables.write_version(spark.range(3).withColumn("domain", F.lit("corrosion")), base, partition_by=["domain"])
    current = tables.read_latest(spark, base)
    target = tables.write_version(current.withColumn("id", F.col("id") + 10), base)
    assert target.endswith("v2")
    assert sorted(r["id"] for r in current.collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in tables.read_latest(spark, base).collect()) == [10, 11, 12]


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    base = str(tmp_path / "t")

    def write(i):
        return tables.write_version(spark.range(1).select(F.lit(i).alias("who")), base)

    made = together(spark, [partial(write, i) for i in range(6)], at_once=6)
    assert sorted(made) == [f"{base}/v{i}" for i in range(1, 7)] and tables.versions(spark, base) == [1, 2, 3, 4, 5, 6]
    held = {tables.read_version(spark, base, v).first()["who"] for v in range(1, 7)}
    assert held == set(range(6))
    assert tables.read_latest(spark, base).first() == tables.read_version(spark, base, 6).first()


def test_one_successor_of_a_version_and_retention(spark, tmp_path):
    base = str(tmp_path / "t")
    tables.write_version(spark.range(1), base, after=0)
    assert tables.write_version(spark.range(2), base, after=1).endswith("v2")
    with pytest.raises(tables.VersionConflict):
        tables.write_version(spark.range(9), base, after=1)
    tables.write_version(spark.range(3), base)
    pinned = tables.read_version(spark, base, 2)
    assert tables.retain(spark, base, keep=2) == [1] and tables.versions(spark, base) == [2, 3]
    assert pinned.count() == 2 and tables.retain(spark, base, keep=0) == [2]
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, base, 2)
    assert tables.write_version(spark.range(4), base).endswith("v4")


def test_a_version_with_violations_is_not_committed(spark, tmp_path):
    base = str(tmp_path / "t")
    tables.write_version(spark.range(3), base, violations={"negative": F.col("id") < 0})
    with pytest.raises(ValueError, match="odd"):
        tables.write_version(spark.range(7), base, violations={"odd": F.col("id") % 2 == 1, "negative": F.col("id") < 0})
    assert tables.versions(spark, base) == [1] and tables.read_latest(spark, base).count() == 3
    assert not (tmp_path / "t" / "v2").exists()


def test_rows_that_cannot_be_read_are_kept_with_a_reason(spark, tmp_path):
    schema = StructType.fromDDL("row_id bigint not null, hardness double, n int, note string")
    lines = ["row_id,hardness,n,note", "1,2.5,3,fine", "2,abc,3,x", "3,,,", ",1.0,1,lost", "5,1.0", "6,1.0,1,a,b", "7,NaN,1.5,y", "x,y,z,w"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    scan = tables.read_checked_csv(spark, str(tmp_path / "a.csv"), schema)
    assert sorted(tuple(r) for r in scan.good.collect()) == [(1, 2.5, 3, "fine"), (3, None, None, None)]
    assert (scan.n_good, scan.n_bad) == (2, 6) and scan.good.columns == schema.names
    assert {r["record"]: r["reason"] for r in scan.bad.collect()} == {
        "2,abc,3,x": "hardness: not a double", ",1.0,1,lost": "row_id: missing", "5,1.0": "wrong number of fields",
        "6,1.0,1,a,b": "wrong number of fields", "7,NaN,1.5,y": "n: not a int",
        "x,y,z,w": "row_id: not a bigint; hardness: not a double; n: not a int"}
    (tmp_path / "empty.csv").write_text("")
    empty = tables.read_checked_csv(spark, str(tmp_path / "empty.csv"), schema)
    assert (empty.n_good, empty.n_bad, empty.good.count(), empty.bad.count()) == (0, 0, 0, 0)


def test_csv_needs_a_schema_and_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.createDataFrame([(1, float("nan")), (2, 1.5)], "row_id long, hardness double").write.option(
        "header", True).csv(path)
    with pytest.raises(ValueError):
        tables.read_table(spark, path, fmt="csv")
    df = tables.read_table(spark, path, "row_id long, hardness double", fmt="csv")
    assert {r["row_id"]: r["hardness"] for r in df.collect()} == {1: None, 2: 1.5}


def test_schema_and_source_names(spark, tmp_path):
    schema = tables.alloy_schema()
    assert len(schema) == len(set(n.lower() for n in schema.names))
    path = str(tmp_path / "t")
    tables.write_derived(spark.createDataFrame([], schema), path)
    assert tables.read_table(spark, path, schema).columns == schema.names
    named = spark.createDataFrame([(1, 2)], "`Hardness (HVN)` int, `std of Tm` int")
    assert tables.rename_source_columns(named).columns == ["hardness", "tm_std"]


def test_feature_config_and_results(spark, tmp_path):
    tables.write_feature_config(spark, str(tmp_path / "config"))
    config = json.loads(spark.read.text(str(tmp_path / "config")).first()[0])
    assert len(config["mech_features"]) == 58 and len(config["corr_features"]) == 66
    assert tables.read_feature_config(spark, str(tmp_path / "config")) == config
    both = report.results_union({"A": spark.range(2), "B": spark.range(3)})
    metrics = spark.createDataFrame([("Hardness", 0.8)], "property string, r2 double")
    tables.write_results(both, metrics, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/results"))
    assert {r["model_family"]: r["n"] for r in back.groupBy("model_family").agg(F.count("*").alias("n")).collect()} == {
        "A": 2, "B": 3}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/metrics")).first()["property"] == "Hardness"


def test_column_rules(spark):
    df = spark.createDataFrame(
        [(1, None, "NaCl", 0.0, 5000.0, -1.0), (2, 3.0, "PBS", 2.0, None, 100.0), (3, 1.5, None, None, -7.0, 0.0)],
        "row_id int, concentration_m double, electrolyte string, hardness double, yield_mpa double, icorr double")
    out = C.prepare_targets(C.add_test_environment(df)).withColumn("clipped", C.clip_to_rule("yield_mpa"))
    rows = {r["row_id"]: r for r in out.collect()}
    assert [rows[i]["conc_norm"] for i in (1, 2, 3)] == [0.0, 0.5, 0.25]
    assert [[rows[i][f] for f in K.ELECTROLYTE_FLAGS] for i in (1, 2, 3)] == [[1, 0, 0, 0, 0, 0, 0], [0] * 7, [0] * 7]
    assert [rows[i]["hardness"] for i in (1, 2, 3)] == [None, 2.0, None]
    assert [rows[i]["icorr_log10"] for i in (1, 2, 3)] == [None, 2.0, None]
    assert [rows[i]["clipped"] for i in (1, 2, 3)] == [5000.0, None, 0.0]
    back = spark.createDataFrame([(9.0,), (-1.0,), (None,)], "v double").select(C.icorr_from_log(F.col("v")).alias("v"))
    assert [r["v"] for r in back.collect()] == [1e6, 0.1, None]


def test_one_hot_guard(spark):
    flags = spark.createDataFrame([(1, 1), (2, 3), (3, 7)], "row_id int, process_class int").withColumns(
        C.process_flags())
    profile.require_one_hot(flags)
    with pytest.raises(ValueError):
        profile.require_one_hot(flags.withColumn("process_1", F.lit(1)))


def test_one_hot_is_checked_by_the_job_that_stores(spark):
    flags = spark.createDataFrame([(1, 1), (2, 3), (3, 7)], "row_id int, process_class int").withColumns(C.process_flags())
    wrong = flags.withColumn("process_1", F.when(F.col("row_id") == 3, F.lit(1)).otherwise(F.col("process_1")))
    assert sorted(profile.stored_one_hot(flags, F.lit(True)).collect()) == sorted(flags.collect())
    assert profile.stored_one_hot(wrong, F.col("row_id") < 3).count() == 3
    with pytest.raises(ValueError, match="more or fewer"):
        profile.stored_one_hot(wrong, F.lit(True))


def test_folds_cover_every_row_once(spark):
    folded = split.with_fold(spark.range(5000).withColumnRenamed("id", "row_id"))
    counts = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == set(range(5)) and sum(counts.values()) == 5000 and min(counts.values()) > 900
    test = folded.where("fold = 2")
    rest = split.nontest_rows(folded, test)
    assert rest.count() + test.count() == 5000 and split.rows_in(rest, test).count() == 0


def test_scores(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, 4.0), ("b", 5.0, 5.0), ("b", 5.0, 4.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, truth double, guess double")
    got = {r["g"]: (r["r2"], r["n"]) for r in evaluate.r2_score(df, "truth", "guess", ["g"]).collect()}
    assert got["a"] == (pytest.approx(0.5), 3) and got["b"] == (None, 2)


def test_export_has_the_published_columns(spark):
    df = spark.createDataFrame([(1, "mechanical", "AlFe", 3500.0, None, 1.0, 2.0, None, 4.0, -7.5)],
                               "row_id int, domain string, composition string, " + ", ".join(
                                   f"{t} double" for t in K.TARGETS))
    export = report.imputed_export(profile.mean_impute(report.with_observed_flags(df), K.TARGETS))
    row = export.first()
    assert (row["hardness_imputed"], row["icorr_log10_imputed"], row["yield_mpa_observed"]) == (3000.0, -6.0, 0)
    assert len(report.export_display(export).columns) == 17


def test_mean_of_nothing_and_empty_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "row_id int, p double, q double")
    model, filled = impute.ChainedImputer(["p", "q"]).fit_transform(df)
    assert model.steps == [] and sorted(filled.collect()) == sorted(df.collect())
