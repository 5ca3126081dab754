"""The queries that grow one family or one imputation do so with forests of the published size."""

import pytest

from meltframe import constants as K
from meltframe.operators import impute, models
from meltframe.plans import catalog


class Seen(Exception):
    pass


def seen(*args, **kwargs):
    raise Seen(*args)


def test_queries_grow_forests_of_the_published_size(spark, monkeypatch):
    """100 trees without a bound below Spark ML's 30 levels for the models, 50 trees of 20 levels and five rounds for the imputation."""
    names = ["row_id", "domain", "electrolyte", *K.TARGETS, *K.CORR_FEATURES]
    table = spark.createDataFrame([], ", ".join(f"{n} {'string' if n in ('domain', 'electrolyte') else 'double'}" for n in names))
    vectors = models.with_vectors(table)
    monkeypatch.setattr(catalog, "_stored_features", lambda spark, d: vectors)
    monkeypatch.setattr(catalog, "_ranges", lambda table: {})
    monkeypatch.setattr(catalog.V, "feature_table", lambda spark, d: table)
    monkeypatch.setattr(models, "_subset", lambda names, df: 8)
    monkeypatch.setattr(models, "grow_all", seen)
    for name, fits in (("rf_regress", 7), ("batch_score", 7), ("rf_classify", 4)):
        with pytest.raises(Seen) as grown:
            catalog.QUERIES[name](spark, "")
        forests = [f.forest for f in grown.value.args[1]]
        assert [(f.trees, f.depth, f.bins, f.leaf_rows) for f in forests] == [(100, 30, 256, 1)] * fits, name
    monkeypatch.setattr(impute.ChainedImputer, "fit_transform", lambda self, df: seen(self))
    with pytest.raises(Seen) as filled:
        catalog.QUERIES["chained_impute"](spark, "")
    imputer = filled.value.args[0]
    assert (imputer.rounds, imputer.forest.trees, imputer.forest.depth, imputer.forest.bins, imputer.forest.leaf_rows) == (5, 50, 20, 256, 1)
    assert list(imputer.columns) == [*K.CORR_FEATURES, *K.TARGETS]
