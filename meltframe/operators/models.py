"""Random forests on feature tables: vectors, fitting, cross-validation, scoring, saving.

Fits on one table (targets, folds, phases) are grown together by `growth`; a single fit, and one too large for that, is a Spark ML
job. Loops run over targets, folds and phases, never over rows. A table that feeds several fits should be stored first (`stored`),
so that its joins and aggregates run once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.storagelevel import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.functions import columns as C
from meltframe.operators import evaluate, growth, scoring, split
from meltframe.session import stored
from meltframe.sources.tables import read_feature_config, write_feature_config

MAX_DEPTH = 30  # the deepest trees Spark ML grows
# Rows of a partition of a layout, at most, about: the least and the most, between them by the size of the forest, since every
# partition sends the sums of all open nodes.
LAYOUT_ROWS = (100_000, 2_000_000)
# Rows in fits side by side: Spark ML keeps a fit's rows in memory as objects.
ROWS_AT_ONCE = 8_000_000


@dataclass(frozen=True)
class Forest:
    """Forest settings. `bins` is the number of split candidates per feature, `leaf_rows` the least rows of a leaf (which
    bounds the trees that reach the driver), `partitions` the layout the bootstrap draws from: part of the seed, in effect.
    Tables of more than `layout_rows` rows a partition get more partitions, by their number of rows alone."""

    trees: int = 100
    depth: int = MAX_DEPTH
    seed: int = 0
    bins: int = 256
    memory_mb: int = 1024
    leaf_rows: int = 1
    partitions: int = 16

    @property
    def layout_rows(self) -> int:
        least, most = LAYOUT_ROWS
        return min(most, max(least, 500 * self.trees * 2 ** self.depth))

    def params(self) -> dict:
        return {"numTrees": self.trees, "maxDepth": self.depth, "seed": self.seed, "maxBins": self.bins,
                "maxMemoryInMB": self.memory_mb, "minInstancesPerNode": self.leaf_rows}


REGRESSOR = Forest()
CLASSIFIER = Forest(seed=4)


@dataclass(frozen=True)
class TargetSpec:
    """One model to train: its target, the rows it may use and its features."""

    target: str
    domain: str | None
    features: Sequence[str] | str  # feature columns, or the name of a ready vector column
    media: Sequence[str] = ()

    def condition(self) -> Column:
        own = F.col(self.target).isNotNull()
        if self.domain:
            own = own & (F.col("domain") == self.domain)
        if self.media:
            own = own & F.col("electrolyte").isin(list(self.media))
        return own

    def rows(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition())


def family_a(mech: Sequence[str] | str = tuple(K.MECH_FEATURES),
             corr: Sequence[str] | str = tuple(K.CORR_FEATURES)) -> list[TargetSpec]:
    """Every target on the observed rows of its own domain, corrosion on the seven listed media only."""
    return [TargetSpec(t, "mechanical", mech) for t in K.MECH_TARGETS] + [
        TargetSpec(t, "corrosion", corr, tuple(K.ELECTROLYTES)) for t in K.CORR_TARGETS
    ]


def family_b(corr: Sequence[str] | str = tuple(K.CORR_FEATURES)) -> list[TargetSpec]:
    """Every target on all rows of the imputed table."""
    return [TargetSpec(t, None, corr) for t in K.TARGETS]


def stable_layout(df: DataFrame, forest: Forest, key: str = "row_id", rows: int = 0) -> DataFrame:
    """Rows placed and ordered by key, since a forest's bootstrap follows the partition layout."""
    return df.repartition(max(forest.partitions, -(-rows // forest.layout_rows)), key).sortWithinPartitions(key)


@contextmanager
def laid_out(df: DataFrame, forest: Forest, key: str = "row_id") -> Iterator[tuple[DataFrame, int]]:
    """The rows of a stored table in the layout of a forest, and how many fits to run side by side on them.

    Many fits then read one layout, kept on the executors' disks, where each would shuffle and sort its vectors for itself. A fit
    filters and projects it, which moves no row. An executor that is lost takes its part along, which is laid out again. What is
    returned lazily must not read the layout: it is gone after the block.
    """
    rows = df.count()
    laid = stable_layout(df, forest, key, rows).persist(StorageLevel.DISK_ONLY)
    try:
        yield laid, max(1, min(4, ROWS_AT_ONCE // max(1, rows)))
    finally:
        laid.unpersist()


def assemble(df: DataFrame, names: Sequence[str] | str, out: str = "features") -> DataFrame:
    """Dense feature vector in the fixed name order; a missing value is an error (fill first).
    A single name is a vector column that exists already."""
    if isinstance(names, str):
        return df.withColumn(out, F.col(names))
    return VectorAssembler(inputCols=list(names), outputCol=out, handleInvalid="error").transform(df)


# --- feature names ---------------------------------------------------------------------
# A vector column carries the names of its features as Spark ML attributes in its metadata; they survive Parquet.

class FeatureMismatch(ValueError):
    """A vector does not hold the features that a model was fitted on."""


def with_feature_names(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Name the features of a vector that was not made by `assemble`."""
    attrs = [{"idx": i, "name": n} for i, n in enumerate(names)]
    return df.withMetadata(vector, {"ml_attr": {"attrs": {"numeric": attrs}, "num_attrs": len(attrs)}})


def feature_names(df: DataFrame, vector: str) -> list[str] | None:
    """Names of a vector's features by position; None where the column carries none."""
    groups = df.schema[vector].metadata.get("ml_attr", {}).get("attrs")
    if not groups:
        return None
    held = {a["idx"]: a.get("name") for group in groups.values() for a in group}
    return [held[i] for i in sorted(held)]


def _difference(have: Sequence[str | None], want: Sequence[str]) -> str:
    lost, extra = [n for n in want if n not in set(have)], [n for n in have if n not in set(want)]
    moved = [] if lost or extra else [n for n, m in zip(want, have, strict=False) if n != m]
    parts = [f"{what}: {', '.join(map(str, names))}" for what, names in (("missing", lost), ("unknown", extra), ("moved", moved)) if names]
    return "; ".join(parts) or f"{len(have)} features for {len(want)}"


def require_features(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """The table, if its vector holds these features in this order. The names decide before anything runs; a vector
    without names is checked by its length, row by row, in the job that reads it."""
    have = feature_names(df, vector)
    if have is None:
        size = F.size(vector_to_array(F.col(vector)))
        fault = F.raise_error(F.concat(F.lit(f"{vector}: "), size.cast("string"), F.lit(f" features for {len(names)}")))
        return df.withColumn(vector, F.when(size == len(names), F.col(vector)).otherwise(fault))
    if list(have) != list(names):
        raise FeatureMismatch(f"{vector}: {_difference(have, names)}")
    return df


def with_vectors(df: DataFrame) -> DataFrame:
    """Add `features_58` and `features_66` and drop the columns only they need: a narrow table to store and fit on."""
    filled = C.fill_zero(df, K.CORR_FEATURES)
    both = assemble(assemble(filled, K.MECH_FEATURES, "features_58"), K.CORR_FEATURES, "features_66")
    return both.drop(*[c for c in K.CORR_FEATURES if c not in K.PHASE_FLAGS])


def disassemble(df: DataFrame, names: Sequence[str], vector: str = "features") -> DataFrame:
    rest = [c for c in df.columns if c != vector]
    return df.withColumn(vector, vector_to_array(F.col(vector))).selectExpr(
        *rest, *[f"get({vector}, {i}) AS `{n}`" for i, n in enumerate(names)]
    )


def _filled(df: DataFrame, names: Sequence[str] | str, out: str) -> DataFrame:
    return assemble(df if isinstance(names, str) else C.fill_zero(df, names), names, out)


def training_rows(df: DataFrame, label: str, names: Sequence[str] | str, forest: Forest, key: str, laid: bool = False) -> DataFrame:
    """Label and feature vector of the rows with a label, in a stable layout (with `laid` the one they are in)."""
    known = df.where(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("double"))
    rows = _filled(known, names, "_vector").select(key, "_label", F.col("_vector").alias("features"))
    return rows if laid else stable_layout(rows, forest, key)


def grow_regressor(rows: DataFrame, forest: Forest) -> RandomForestRegressionModel:
    return RandomForestRegressor(featuresCol="features", labelCol="_label", featureSubsetStrategy="all",
                                 **forest.params()).fit(rows)


def fit_regressor(df: DataFrame, target: str, names: Sequence[str] | str, forest: Forest = REGRESSOR,
                  key: str = "row_id", laid: bool = False) -> RandomForestRegressionModel:
    """Forest over all features at each split, the target as given (take `icorr_log10` for the log target)."""
    return grow_regressor(training_rows(df, target, names, forest, key, laid), forest)


def grow_classifier(rows: DataFrame, forest: Forest) -> RandomForestClassificationModel:
    return RandomForestClassifier(featuresCol="features", labelCol="_label", featureSubsetStrategy="sqrt", **forest.params()).fit(rows)


def fit_classifier(df: DataFrame, label: str, names: Sequence[str] | str, forest: Forest = CLASSIFIER,
                   key: str = "row_id", laid: bool = False) -> RandomForestClassificationModel:
    """Forest over a square-root sample of the features at each split."""
    return grow_classifier(training_rows(df, label, names, forest, key, laid), forest)


def with_vector_of(df: DataFrame, lists: Sequence[Sequence[str] | str]) -> tuple[DataFrame, list[str]]:
    """The table with a vector column for each of the feature lists, equal lists sharing one, and the name of each."""
    names: dict = {}
    for features in lists:
        held = features if isinstance(features, str) else tuple(features)
        if held not in names:
            names[held] = held if isinstance(held, str) else f"_vector{len(names)}"
            df = df if isinstance(held, str) else _filled(df, held, names[held])
    return df, [names[f if isinstance(f, str) else tuple(f)] for f in lists]


def grow_all(df: DataFrame, fits: Sequence[growth.Fit], lists: Sequence[Sequence[str] | str], key: str) -> list:
    """The forests of many fits on a stored table, each over its list of features; in the order given.

    Fits over the same features share split candidates, quantiles of the rows any of them uses, and a job (see `growth`). A fit of more
    rows than a unit holds, or with more bins than a byte has, is Spark ML's, one after another.
    """
    df, vectors = with_vector_of(df, lists)
    models: list = [None] * len(fits)
    rows, classes = growth.facts(df, fits)
    local: dict[tuple, list[int]] = {}
    for i, (fit, vector) in enumerate(zip(fits, vectors, strict=True)):
        if growth.holds(fit.forest, rows[i], classes[i]):
            local.setdefault((vector, fit.forest.bins), []).append(i)
            continue
        known = df.where(fit.rows & fit.label.isNotNull()).select(key, fit.label.cast("double").alias("_label"), F.col(vector).alias("features"))
        laid = stable_layout(known, fit.forest, key, rows[i])
        models[i] = grow_classifier(laid, fit.forest) if fit.classifies else grow_regressor(laid, fit.forest)
    for (vector, bins), members in local.items():
        values, mine = vector_to_array(F.col(vector)), [fits[i] for i in members]
        used = df.where(reduce(lambda a, b: a | b, [F.coalesce(f.rows & f.label.isNotNull(), F.lit(False)) for f in mine]))
        cuts = growth.candidates(used, values, bins, sum(rows[i] for i in members))
        grown = growth.grow(used, values, mine, key, cuts, [rows[i] for i in members], [classes[i] for i in members])
        for i, model in zip(members, grown, strict=True):
            models[i] = model
    return models


def _subset(names: Sequence[str] | str, df: DataFrame) -> int:
    """How many features a classifier's node looks at: the square root of their number."""
    width = len(names) if not isinstance(names, str) else len(feature_names(df, names) or ()) or (
        df.select(F.max(F.size(vector_to_array(F.col(names))))).first()[0] or 0)
    return math.ceil(math.sqrt(width))


def predict(df: DataFrame, models: Mapping[str, object], names: Sequence[str] | str,
            probability: bool = False) -> DataFrame:
    """Add one column per model (`name`), and `<name>_probability` of class 1 if asked; one vector for all.

    Several models are scored together, a batch of rows at a time; a single one by its own transform.
    """
    out = _filled(df, names, "_features")
    grown = {name: m for name, m in models.items() if isinstance(m, growth.GrownForest)}
    if grown:
        models = {name: m for name, m in models.items() if name not in grown}
        out = scoring.grown_scores(out, grown, "_features", probability)
    if len(models) > 1:
        flat = scoring.flat_forests(df.sparkSession, models)
        out = out.withColumn("_scores", scoring.batch_scores(flat, vector_to_array(F.col("_features"))))
        added = {}
        for i, (name, forest) in enumerate(flat.items()):
            added[name] = F.col(f"_scores.p{i}")
            if probability and forest.classifies:
                added[f"{name}_probability"] = F.col(f"_scores.c{i}")
        return out.withColumns(added).drop("_features", "_scores")
    for name, model in models.items():
        columns, helpers = {model.featuresCol: "_features", model.predictionCol: name}, []
        if isinstance(model, RandomForestClassificationModel):
            helpers = ["_raw", "_prob"]
            columns |= {model.rawPredictionCol: "_raw", model.probabilityCol: "_prob"}
        out = model.copy(columns).transform(out)
        if helpers and probability:
            out = out.withColumn(f"{name}_probability", F.get(vector_to_array(F.col("_prob")), F.lit(1)))
        out = out.drop(*helpers)
    return out.drop("_features")


# --- evaluation ------------------------------------------------------------------------

def _needed(names: Sequence[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _cross_predict(df: DataFrame, specs: Sequence[TargetSpec], folds: int, forest: Forest, key: str) -> list[DataFrame]:
    """`cross_predict` of several specs on rows with folds: all folds of all specs are grown together, each fold scored once."""
    fits = [growth.Fit(F.col(s.target), s.condition() & (F.col("fold") != k), forest) for s in specs for k in range(folds)]
    models = grow_all(df, fits, [s.features for s in specs for _ in range(folds)], key)
    by_features: dict = {}
    for i, s in enumerate(specs):
        by_features.setdefault(s.features if isinstance(s.features, str) else tuple(s.features), []).append(i)
    guesses: list = [None] * len(specs)
    for features, members in by_features.items():
        rows = df.where(reduce(lambda a, b: a | b, [F.coalesce(specs[i].condition(), F.lit(False)) for i in members]))
        parts = []
        for k in range(folds):
            scored = predict(rows.where(F.col("fold") == k), {f"_guess{i}": models[i * folds + k] for i in members}, features)
            cells = [F.when(specs[i].condition(), F.struct(F.col(specs[i].target).alias("truth"), F.col(f"_guess{i}").alias("guess"))) for i in members]
            parts.append(scored.select(key, "fold", *[c.alias(f"_cell{i}") for i, c in zip(members, cells, strict=True)]))
        held = stored(reduce(DataFrame.unionByName, parts))
        for i in members:
            guesses[i] = held.where(F.col(f"_cell{i}").isNotNull()).select(key, "fold", f"_cell{i}.truth", f"_cell{i}.guess")
    return guesses


def cross_predict(df: DataFrame, target: str, names: Sequence[str] | str, folds: int = 5, forest: Forest = REGRESSOR,
                  key: str = "row_id") -> DataFrame:
    """(key, fold, truth, guess): every observed row predicted by the model that did not see its fold."""
    rows = df if "fold" in df.columns else split.with_fold(df, key, folds)
    return _cross_predict(rows, [TargetSpec(target, None, names)], folds, forest, key)[0]


def cv_r2(df: DataFrame, specs: Sequence[TargetSpec], folds: int = 5, forest: Forest = REGRESSOR,
          key: str = "row_id") -> DataFrame:
    """R² mean and deviation over the folds, one row per target; all folds of all targets are grown together."""
    df = df if "fold" in df.columns else split.with_fold(df, key, folds)
    guesses = [g.withColumn("property", F.lit(K.TARGET_LABELS[s.target])) for s, g in
               zip(specs, _cross_predict(df, specs, folds, forest, key), strict=True)]
    scores = evaluate.r2_score(reduce(DataFrame.unionByName, guesses), "truth", "guess", ["property", "fold"])
    return evaluate.cv_summary(scores, ["property"])


def holdout_accuracy(df: DataFrame, label: str, names: Sequence[str] | str, forest: Forest = CLASSIFIER,
                     key: str = "row_id") -> tuple[object, DataFrame]:
    """Classifier fitted on the 90 % part and its accuracy on the held-out 10 %."""
    return holdout_accuracies(df, [label], names, forest, key)[0]


def holdout_accuracies(df: DataFrame, labels: Sequence[str], names: Sequence[str] | str, forest: Forest = CLASSIFIER,
                       key: str = "row_id") -> list[tuple[object, DataFrame]]:
    """`holdout_accuracy` of several labels, grown together."""
    parted = split.with_holdout(df, key)
    fits = [growth.Fit(F.col(label), ~F.col("is_test"), forest, True, _subset(names, df)) for label in labels]
    models = grow_all(parted, fits, [names] * len(labels), key)
    tested = predict(parted.where("is_test"), {f"_guess{i}": m for i, m in enumerate(models)}, names)
    tested = stored(tested.select(*[F.col(label).alias(f"_truth{i}") for i, label in enumerate(labels)], *[f"_guess{i}" for i in range(len(labels))]))
    return [(model, evaluate.accuracy(tested.where(F.col(f"_truth{i}").isNotNull()), f"_truth{i}", f"_guess{i}").withColumn("phase", F.lit(label)))
            for i, (label, model) in enumerate(zip(labels, models, strict=True))]


def train_family(df: DataFrame, specs: Sequence[TargetSpec], forest: Forest = REGRESSOR, key: str = "row_id") -> dict[str, object]:
    """One regressor per spec on all its rows, grown together."""
    fits = [growth.Fit(F.col(s.target), s.condition(), forest) for s in specs]
    return dict(zip([s.target for s in specs], grow_all(df, fits, [s.features for s in specs], key), strict=True))


def train_phases(df: DataFrame, forest: Forest = CLASSIFIER, names: Sequence[str] | str = tuple(K.MECH_FEATURES),
                 include_phase: bool = True, key: str = "row_id") -> dict[str, object]:
    """One classifier per phase, grown together. With `include_phase` the flags stay among the features, the label included,
    as in the published procedure; without it they are held at zero, as they are when scoring."""
    # the label doubles as a feature, so it is copied under another name
    rows = df.withColumns({f"_{p}": F.col(p) for p in K.PHASE_FLAGS})
    if not include_phase:
        if isinstance(names, str):
            raise ValueError("phase slots can only be emptied in feature columns")
        rows = rows.withColumns({p: F.lit(0) for p in K.PHASE_FLAGS})
    fits = [growth.Fit(F.col(f"_{p}"), F.lit(True), forest, True, _subset(names, df)) for p in K.PHASE_FLAGS]
    return dict(zip(K.PHASE_FLAGS, grow_all(rows, fits, [names] * len(fits), key), strict=True))


# --- scoring ---------------------------------------------------------------------------

@dataclass
class Family:
    """Regressors and phase classifiers that are used together."""

    regressors: dict[str, object]
    phases: dict[str, object]
    mech_features: Sequence[str] = field(default_factory=lambda: list(K.MECH_FEATURES))

    def save(self, path: str) -> None:
        for kind, models in (("regressor", self.regressors), ("classifier", self.phases)):
            for name, model in models.items():
                PipelineModel([scoring.spark_model(SparkSession.active(), model)]).write().overwrite().save(f"{path}/{kind}_{name}")
        spark = SparkSession.active()
        write_feature_config(spark, f"{path}/feature_config")
        held = {"regressors": list(self.regressors), "phases": list(self.phases), "mech_features": list(self.mech_features)}
        spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/family")

    def score_vectors(self, df: DataFrame, mech: str = "features_58", corr: str = "features_66") -> DataFrame:
        """One column per target from ready vectors (`mech` for the mechanical targets, where the family has own features for
        them). Vectors with other features, or the same in another order, raise `FeatureMismatch` with the names."""
        vector_of = {t: mech if t in K.MECH_TARGETS and list(self.mech_features) == K.MECH_FEATURES else corr for t in self.regressors}
        for vector in sorted(set(vector_of.values())):
            df = require_features(df, vector, K.MECH_FEATURES if vector == mech else K.CORR_FEATURES)
            df = predict(df, {t: m for t, m in self.regressors.items() if vector_of[t] == vector}, vector)
        return df

    @staticmethod
    def load(path: str) -> Family:
        """The models saved under the path, with the features they were fitted on. A family fitted on other feature lists than
        this library's, or with a model of another width, raises `FeatureMismatch`."""
        config = read_feature_config(SparkSession.active(), f"{path}/feature_config")
        for name, now in (("mech_features", K.MECH_FEATURES), ("corr_features", K.CORR_FEATURES)):
            if config[name] != now:
                raise FeatureMismatch(f"{path}, {name}: {_difference(config[name], now)}")
        held = json.loads(SparkSession.active().read.text(f"{path}/family").first()[0])

        def read(kind: str, name: str):
            return PipelineModel.load(f"{path}/{kind}_{name}").stages[0]

        family = Family({t: read("regressor", t) for t in held["regressors"]}, {p: read("classifier", p) for p in held["phases"]},
                        held["mech_features"])
        for t, model in family.regressors.items():
            width = len(family.mech_features if t in K.MECH_TARGETS else K.CORR_FEATURES)
            if model.numFeatures != width:
                raise FeatureMismatch(f"{path}, {t}: {model.numFeatures} features for {width}")
        return family


def two_stage_score(df: DataFrame, family: Family, phase_objectives: bool = False) -> DataFrame:
    """Phases from features with empty phase slots, then the properties from features that hold those phases.

    Adds the phase flags, `<phase>_probability`, one column per target and, if asked, `<phase>_objective`:
    the classifier's label on the features that already hold the phases.
    """
    blank = df.withColumns({p: F.lit(0.0) for p in K.PHASE_FLAGS})
    guessed = predict(blank, {f"_{p}": m for p, m in family.phases.items()}, K.MECH_FEATURES, probability=True)
    filled = guessed.withColumns({p: F.col(f"_{p}") for p in family.phases}).drop(*[f"_{p}" for p in family.phases])
    filled = filled.withColumnsRenamed({f"_{p}_probability": f"{p}_probability" for p in family.phases})
    if phase_objectives:
        filled = predict(filled, {f"{p}_objective": m for p, m in family.phases.items()}, K.MECH_FEATURES)
    groups: dict[tuple[str, ...], dict] = {}
    for target, model in family.regressors.items():
        names = family.mech_features if target in K.MECH_TARGETS else K.CORR_FEATURES
        groups.setdefault(tuple(names), {})[target] = model
    for names, models in groups.items():
        filled = predict(filled.drop(*models), models, names)
    return filled


def environment(df: DataFrame, electrolyte: str, concentration_m: float) -> DataFrame:
    """One test environment for all rows, as flags and scaled concentration."""
    flags: dict[str, Column] = {
        n: F.lit(1 if e == electrolyte else 0) for e, n in zip(K.ELECTROLYTES, K.ELECTROLYTE_FLAGS, strict=True)
    }
    return df.withColumns({**flags, "conc_norm": F.lit(concentration_m / K.MAX_CONCENTRATION_M)})


def process_from_scores(df: DataFrame, scores: str = "process_scores") -> DataFrame:
    """The seven raw process scores of a candidate as its process features."""
    return df.withColumns({n: F.coalesce(F.get(scores, F.lit(i)), F.lit(0.0)) for i, n in enumerate(K.PROCESS_FLAGS)})
