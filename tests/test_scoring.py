"""Forests scored in batches answer as Spark ML's own transforms do."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meltframe.operators import models, scoring
from meltframe.operators.models import Forest


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(5)
    x = g.random((700, 4)).round(2)
    out = [(i, *map(float, r), float(5 * r[0] - r[1] ** 2), float(r[2] > 0.4), float((r[0] + r[3]) * 2 // 1), 1.0) for i, r in enumerate(x)]
    return spark.createDataFrame(out, "row_id long, a double, b double, c double, d double, y double, two double, many double, same double")


NAMES = ["a", "b", "c", "d"]


def test_equal_to_spark_ml(spark, rows):
    forest = Forest(trees=7, depth=6, bins=16)
    fitted = {
        "y_guess": models.fit_regressor(rows, "y", NAMES, forest), "same_guess": models.fit_regressor(rows, "same", NAMES, forest),
        "two_guess": models.fit_classifier(rows, "two", NAMES, forest), "many_guess": models.fit_classifier(rows, "many", NAMES, forest),
    }
    nothing = spark.createDataFrame([(9_000, float("nan"), 0.5, float("inf"), -1.0)], "row_id long, a double, b double, c double, d double")
    vectors = rows.select("row_id", *NAMES).union(nothing).select("row_id", array_to_vector(F.array(*NAMES)).alias("v"), F.lit(1).alias("_p0"))
    together = models.predict(vectors, fitted, "v", probability=True).orderBy("row_id").collect()
    alone = vectors
    for name, model in fitted.items():
        alone = models.predict(alone, {name: model}, "v", probability=True)
    alone = alone.orderBy("row_id").collect()
    assert len(together) == 701 and together[0].asDict().keys() == alone[0].asDict().keys()
    for one, other in zip(together, alone):
        for name, value in ((n, x) for n, x in other.asDict().items() if n != "v"):
            assert value == one[name] or abs(value - one[name]) <= 1e-12, (name, one["row_id"])
    assert len({r["y_guess"] for r in together}) > 50 and {r["same_guess"] for r in together} == {1.0}


def test_empty_table_and_other_widths(rows):
    forest = Forest(trees=2, depth=2, bins=8)
    both = {"g": models.fit_regressor(rows, "y", NAMES, forest), "h": models.fit_regressor(rows, "two", NAMES, forest)}
    assert models.predict(rows.limit(0), both, NAMES).count() == 0
    other = models.fit_regressor(rows, "y", NAMES[:3], forest)
    with pytest.raises(ValueError, match="different lengths"):
        models.predict(rows, {**both, "i": other}, NAMES)
    with pytest.raises(Exception, match="4 features expected"):
        models.predict(rows, both, NAMES[:3]).select("g").collect()


def test_splits_by_category_are_refused(spark, rows):
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    coded = StringIndexer(inputCol="many", outputCol="code").fit(rows).transform(rows)
    coded = VectorAssembler(inputCols=["code"], outputCol="features").transform(coded)
    model = RandomForestRegressor(labelCol="many", numTrees=2, maxDepth=2, seed=1).fit(coded)
    with pytest.raises(ValueError, match="category"):
        scoring.flat_forests(spark, {"g": model})
