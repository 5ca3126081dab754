"""Named queries: each runs one operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meltframe import constants as K
from meltframe.functions import columns as C
from meltframe.functions import text as T
from meltframe.operators import composition as comp
from meltframe.operators import evaluate, impute, models, pareto, profile, report, rules, screen, split
from meltframe.plans import views as V
from meltframe.plans import workflows as W
from meltframe.session import shared_path, stored, tune
from meltframe.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The request the constraint queries screen the alloys with.
REQUEST = screen.ScreenRequest(
    allowed=[e for e in K.ELEMENTS if e not in ("Ca", "Nd", "Re")], required=["Al"], max_elements=4
)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return C.prepare_targets(V.alloy_record(spark, d))


# --- scans, projections -------------------------------------------------------------

@query
def scan_profile(spark, d):
    cols = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return profile.scan_profile(V.table(spark, d, "lineitem"), cols)


@query
def electrolyte_onehot(spark, d):
    return V.alloy_record(spark, d).select("row_id", *[c.alias(n) for n, c in C.electrolyte_flags().items()])


@query
def process_onehot(spark, d):
    classed = V.noted_record(spark, d).select("row_id", T.process_class(F.col("phrase")).alias("process_class"))
    return classed.select("row_id", *[c.alias(n) for n, c in C.process_flags().items()])


@query
def conc_norm(spark, d):
    return V.alloy_record(spark, d).select("row_id", C.concentration_norm().alias("conc_norm"))


@query
def zero_as_missing(spark, d):
    return V.alloy_record(spark, d).select("row_id", *[C.zero_as_missing(t).alias(t) for t in K.RAW_TARGETS])


@query
def log10_positive(spark, d):
    return V.alloy_record(spark, d).select("row_id", F.round(C.log10_positive("icorr"), 9).alias("icorr_log10"))


@query
def icorr_backtransform(spark, d):
    """Predicted log10 values (price in units of 50,000, shifted) back to current densities."""
    log = F.col("o_totalprice") / 50000 - 3
    return V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.round(C.icorr_from_log(log), 4).alias("icorr")
    )


@query
def clip_rules(spark, d):
    return prepared(spark, d).select(
        "row_id", *[F.round(C.clip_to_rule(t), 9).alias(t) if t == "icorr_log10" else C.clip_to_rule(t).alias(t)
                    for t in K.TARGETS]
    )


@query
def fill_zero(spark, d):
    return C.fill_zero(V.alloy_record(spark, d).select("row_id", "concentration_m", "hardness"),
                       ["concentration_m", "hardness"])


@query
def observed_flags(spark, d):
    return prepared(spark, d).select("row_id", *[C.observed(t).alias(f"{t}_observed") for t in K.TARGETS])


@query
def masked_update(spark, d):
    """Densities computed from the composition, written back to the corrosion rows only."""
    record = V.alloy_record(spark, d).select("row_id", "domain", F.col("fcc").cast("double").alias("density"))
    computed = comp.mixture_density(V.raw_amounts(spark, d)).withColumnRenamed("density", "computed")
    value = C.update_where(F.col("domain") == "corrosion", F.coalesce("computed", F.lit(0.0)), F.col("density"))
    return record.join(computed, "row_id", "left").select("row_id", "domain", value.alias("density"))


@query
def display_projection(spark, d):
    record = V.alloy_record(spark, d)
    return record.select(
        "row_id", F.col("domain").alias("OG property"),
        *[F.col(t).alias(f"{K.TARGET_LABELS[t]} (observed)") for t in ("hardness", "icorr")],
    )


def _features(spark, d, names):
    table = C.fill_zero(V.feature_table(spark, d), names)
    vector = models.assemble(table, names)
    return models.disassemble(vector.select("row_id", "features"), names)


@query
def features_58(spark, d):
    return _features(spark, d, K.MECH_FEATURES)


@query
def features_66(spark, d):
    return _features(spark, d, K.CORR_FEATURES)


# --- filters ------------------------------------------------------------------------

@query
def domain_filter(spark, d):
    return V.alloy_record(spark, d).where(F.col("domain") == "mechanical").select("row_id", "hardness")


@query
def electrolyte_filter(spark, d):
    return (
        V.alloy_record(spark, d)
        .where((F.col("domain") == "corrosion") & F.col("electrolyte").isin(K.ELECTROLYTES))
        .select("row_id", "electrolyte")
    )


@query
def labelled_rows(spark, d):
    return prepared(spark, d).na.drop(subset=["hardness"]).select("row_id", "hardness")


@query
def min_support(spark, d):
    corrosion = prepared(spark, d).where(F.col("domain") == "corrosion")
    return evaluate.min_support(corrosion, "icorr_log10", "electrolyte")


@query
def constraint_max_elements(spark, d):
    return screen.violations(V.wide(spark, d), REQUEST).select("row_id", "v_max_elements")


@query
def constraint_banned(spark, d):
    return screen.violations(V.wide(spark, d), REQUEST).select("row_id", *[f"v_banned_{e}" for e in REQUEST.banned])


@query
def constraint_required(spark, d):
    return screen.violations(V.wide(spark, d), REQUEST).select(
        "row_id", *[f"v_required_{e}" for e in REQUEST.required]
    )


@query
def constraint_max_fraction(spark, d):
    return screen.violations(V.wide(spark, d), REQUEST).select("row_id", "v_max_fraction")


@query
def feasibility(spark, d):
    return screen.violations(V.wide(spark, d), REQUEST).select(
        "row_id", *screen.violation_columns(REQUEST), F.round("total_violation", 9).alias("total_violation"), "feasible"
    )


def _strings(spark, d):
    return comp.with_total(V.wide(spark, d)).select(
        "row_id", T.composition_string(comp.present_shares()).alias("composition")
    )


@query
def banned_string_filter(spark, d):
    return screen.banned_string_filter(_strings(spark, d), ["C", "N", "V"])


@query
def banned_complement(spark, d):
    """Elements outside the pool of those supplied in more than the average amount."""
    totals = comp.element_totals(V.raw_amounts(spark, d))
    average = totals.agg(F.avg("total")).scalar()
    props = comp.element_props(spark)
    allowed = totals.where(F.col("total") > average).join(F.broadcast(props), "elem_idx").select("elem")
    return screen.banned_complement(props, allowed)


# --- lookups ------------------------------------------------------------------------

@query
def element_lookup(spark, d):
    return comp.element_lookup(V.composition_long(spark, d), comp.element_props(spark))


@query
def element_pairs(spark, d):
    return comp.element_pairs(V.wide(spark, d))


@query
def pair_enthalpy(spark, d):
    return comp.pair_lookup(comp.element_pairs(V.wide(spark, d)), comp.pair_table(spark)).select(
        "row_id", "e1", "e2", "h"
    )


@query
def observed_vs_imputed(spark, d):
    filled = profile.mean_impute(prepared(spark, d).select("row_id", *K.TARGETS), K.TARGETS, suffix="_filled")
    out = profile.observed_vs_imputed(filled, {t: (t, f"{t}_filled") for t in K.TARGETS})
    return out.select("column", "kind", "n", *[F.round(s, 6).alias(s) for s in ("low", "high", "mean")])


@query
def nontest_rows(spark, d):
    folded = split.with_fold(V.alloy_record(spark, d).select("row_id", "domain"))
    return split.outside_fold(folded, 0)


@query
def process_label(spark, d):
    classed = V.noted_record(spark, d).select(
        "row_id", F.when(F.col("domain") == "corrosion", T.process_class(F.col("phrase"))).alias("process_class")
    )
    return classed.select("row_id", "process_class", T.process_label(F.col("process_class")).alias("process"))


# --- composition aggregates ---------------------------------------------------------

@query
def fractions(spark, d):
    return comp.fractions(V.wide(spark, d))


@query
def weighted_means(spark, d):
    return comp.weighted_means(V.raw_amounts(spark, d))


def _params(spark, d, *names):
    return comp.empirical_params(V.wide(spark, d), names=list(names))


@query
def weighted_stds(spark, d):
    return _params(spark, d, "tm_std", "chi_std", "vec_std", "bulk_std")


@query
def size_mismatch(spark, d):
    return _params(spark, d, "delta")


@query
def mixing_entropy(spark, d):
    return _params(spark, d, "entropy").withColumn("entropy", F.round("entropy", 6))


@query
def mixing_enthalpy(spark, d):
    return _params(spark, d, "enthalpy")


@query
def enthalpy_spread(spark, d):
    return _params(spark, d, "enthalpy_spread")


@query
def omega(spark, d):
    return _params(spark, d, "omega").withColumn("omega", F.round("omega", 6))


@query
def mixture_density(spark, d):
    return comp.mixture_density(V.raw_amounts(spark, d))


@query
def empirical_params(spark, d):
    out = comp.empirical_params(V.wide(spark, d))
    return out.withColumns({n: F.round(n, 6) for n in ("entropy", "omega")})


@query
def array_density(spark, d):
    return V.candidates(spark, d).select(
        "row_id",
        comp.array_density(F.transform(F.slice("raw", 1, 32), lambda a: a.cast("double"))).alias("density"),
    )


@query
def n_elements(spark, d):
    return comp.with_total(V.wide(spark, d)).select("row_id", comp.n_elements().alias("n_elements"))


@query
def composition_summary(spark, d):
    wide = comp.with_total(V.wide(spark, d)).withColumn("present", comp.present_shares())
    total = F.aggregate("present", F.lit(0.0), lambda acc, t: acc + t["share"])
    return wide.select(
        "row_id", comp.n_elements().alias("n_elements"), comp.max_share().alias("max_fraction"),
        comp.share("Al").alias("al_fraction"), F.round(total, 4).alias("composition_sum"),
    )


@query
def composition_string(spark, d):
    return _strings(spark, d)


@query
def composition_parse(spark, d):
    return _strings(spark, d).select("row_id", F.inline(T.parse_composition(F.col("composition"))))


# --- profiles -----------------------------------------------------------------------

@query
def domain_counts(spark, d):
    return profile.domain_counts(V.alloy_record(spark, d))


def _flagged(spark, d):
    record = V.noted_record(spark, d).withColumn("process_class", T.process_class(F.col("phrase")))
    return record.withColumns(C.process_flags())


@query
def process_flag_sums(spark, d):
    return profile.column_sums(_flagged(spark, d), K.PROCESS_FLAGS, F.col("domain") == "corrosion")


@query
def process_histogram(spark, d):
    return profile.histogram(_flagged(spark, d).where(F.col("domain") == "corrosion"), "process_class")


@query
def onehot_violations(spark, d):
    """Records whose phase flags are not exactly one."""
    return profile.onehot_violations(V.alloy_record(spark, d), K.PHASE_FLAGS).select("row_id", *K.PHASE_FLAGS)


@query
def missing_profile(spark, d):
    return profile.missing_profile(prepared(spark, d), ["electrolyte", "concentration_m", *K.TARGETS])


@query
def composition_bounds(spark, d):
    return profile.composition_bounds(V.wide(spark, d))


@query
def domain_means(spark, d):
    names = ["delta", "tm", "entropy", "vec", "density"]
    params = comp.empirical_params(V.wide(spark, d), names=names)
    record = V.alloy_record(spark, d).select("row_id", "domain")
    means = profile.domain_means(record.join(params, "row_id", "left").na.fill(0.0, subset=names), names)
    return means.select("domain", *[F.round(n, 6).alias(n) for n in names])


@query
def sample_mappings(spark, d):
    """The first twenty notes, as the reference report shows them."""
    return profile.sample_notes(_flagged(spark, d))


@query
def mean_impute(spark, d):
    out = profile.mean_impute(prepared(spark, d).select("row_id", *K.TARGETS), K.TARGETS)
    return out.select("row_id", *[F.round(t, 6).alias(t) for t in K.TARGETS])


@query
def imputed_export(spark, d):
    seen = prepared(spark, d).withColumn("composition", F.lit(None).cast("string"))
    return report.imputed_export(profile.mean_impute(report.with_observed_flags(seen), K.TARGETS))


# --- splits and scores --------------------------------------------------------------

@query
def kfold(spark, d):
    return split.with_fold(V.alloy_record(spark, d).select("row_id"))


@query
def kfold_exact(spark, d):
    """Folds of equal size, give or take one row."""
    return split.with_exact_fold(V.alloy_record(spark, d).select("row_id"))


@query
def holdout_exact(spark, d):
    """Exactly a tenth of the rows, rounded up."""
    return split.with_exact_holdout(V.alloy_record(spark, d).select("row_id"))


@query
def holdout_split(spark, d):
    return split.with_holdout(V.alloy_record(spark, d).select("row_id"))


def _fold_scores(spark, d):
    """Fold scores of two guesses: A as given, B with a constant offset."""
    rows = V.scored_rows(spark, d)
    both = {"A": rows, "B": rows.withColumn("guess", F.col("guess") + 5000)}
    scores = [
        evaluate.r2_score(df, "truth", "guess", ["property", "fold"]).withColumn("model_family", F.lit(name))
        for name, df in both.items()
    ]
    return scores[0].unionByName(scores[1])


@query
def r2_by_fold(spark, d):
    return evaluate.r2_score(V.scored_rows(spark, d), "truth", "guess", ["fold"]).withColumn("r2", F.round("r2", 9))


@query
def accuracy(spark, d):
    """Flag `fcc` against the guess `bcc`, per domain."""
    return evaluate.accuracy(V.alloy_record(spark, d), "fcc", "bcc", ["domain"])


@query
def cv_summary(spark, d):
    out = evaluate.cv_summary(_fold_scores(spark, d), ["property", "model_family"])
    return out.select("property", "model_family", F.round("r2", 9).alias("r2"), F.round("std", 9).alias("std"), "n")


@query
def metrics_report(spark, d):
    return report.metrics_report(evaluate.cv_summary(_fold_scores(spark, d), ["property", "model_family"]))


@query
def model_compare(spark, d):
    summary = evaluate.cv_summary(_fold_scores(spark, d), ["property", "model_family"])
    wide = evaluate.compare_families(summary)
    return wide.select("property", F.round("A", 9).alias("r2_a"), F.round("B", 9).alias("r2_b"))


@query
def results_union(spark, d):
    """Feasible alloys of two screens in one table."""
    loose = screen.ScreenRequest(allowed=REQUEST.allowed, max_elements=3)
    found = {
        name: screen.violations(V.wide(spark, d), request).where("feasible").select("row_id")
        for name, request in {"A": REQUEST, "B": loose}.items()
    }
    return report.results_union(found)


# --- text ---------------------------------------------------------------------------

@query
def process_class(spark, d):
    return V.noted_record(spark, d).select("row_id", "phrase", T.process_class(F.col("phrase")).alias("process_class"))


@query
def process_class_documents(spark, d):
    """The same rules over whole documents."""
    return V.table(spark, d, "documents").select("doc_id", T.process_class(F.col("text")).alias("process_class"))


@query
def process_rules_documents(spark, d):
    """Whole documents again, the rules as a table and one automaton for all of them."""
    out = rules.classify(V.table(spark, d, "documents").select("doc_id", "text"), F.col("text"), rules.rule_table(spark), "process_class")
    return out.drop("text")


@query
def checked_scan(spark, d):
    """The orders as CSV lines, some broken by rule: what could be read, and for the others the key and the reason."""
    key = F.col("o_orderkey")
    cust = F.when(key % 97 == 0, F.concat(F.lit("x"), F.col("o_custkey"))).otherwise(F.col("o_custkey").cast("string"))
    price = F.when(key % 89 == 0, F.lit("n/a")).when(key % 83 == 0, F.lit("")).otherwise(F.col("o_totalprice").cast("string"))
    tail = F.when(key % 101 == 0, F.lit(",more")).otherwise(F.lit(""))
    path = shared_path(spark, "lines")
    V.table(spark, d, "orders").select(F.concat(F.concat_ws(",", key, cust, price), tail)).write.text(path)
    schema = "o_orderkey bigint not null, o_custkey bigint not null, o_totalprice double"
    scan = tables.read_checked_csv(spark, path, StructType.fromDDL(schema), header=False)
    bad = scan.bad.select(F.split_part("record", F.lit(","), F.lit(1)).cast("bigint").alias("o_orderkey"), "reason")
    return scan.good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query
def process_argmax(spark, d):
    best = T.first_max(F.slice("raw", 33, 7))
    return V.candidates(spark, d).select(
        "row_id", best.alias("best"), T.process_label(best + 1).alias("process")
    )


@query
def phase_label(spark, d):
    """Scores 33..36 of each candidate as phase scores; a phase is present above 0.15."""
    scores = [F.get("raw", F.lit(32 + i)) for i in range(4)]
    flags = [F.when(s > 150000, F.lit(1)).otherwise(F.lit(0)) for s in scores]
    return V.candidates(spark, d).select("row_id", T.phase_label(flags, scores).alias("phase"))


# --- screening ----------------------------------------------------------------------

@query
def candidates(spark, d):
    out = screen.latent_candidates(V.table(spark, d, "orders").withColumnRenamed("o_orderkey", "row_id"), "row_id")
    return out.select("row_id", *[F.get("latent", F.lit(i)).alias(f"z{i}") for i in range(10)])


def weight_table(spark: SparkSession) -> DataFrame:
    """Stand-in weights for the three dense layers 10 -> 39 -> 39 -> 39: small whole numbers from a rule."""
    return spark.sql("""
        SELECT layer, unit, input, CAST((unit * 7 + input * 3 + layer * 2 + 3) % 5 - 2 AS DOUBLE) AS weight
        FROM (SELECT explode(sequence(0, 2)) AS layer)
        LATERAL VIEW explode(sequence(0, 38)) AS unit
        LATERAL VIEW explode(sequence(-1, CASE WHEN layer = 0 THEN 9 ELSE 38 END)) AS input
    """)


@query
def dense_relu(spark, d):
    latent = V.candidates(spark, d).select("row_id", F.slice("raw", 1, 10).alias("latent"))
    out = screen.dense_relu(latent, "latent", screen.layer_weights(weight_table(spark), (10, 39, 39, 39)))
    return out.select("row_id", F.posexplode("raw").alias("unit", "value"))


@query
def decode_candidates(spark, d):
    out = screen.decode(V.candidates(spark, d), profile.bounds_row(V.wide(spark, d)))
    return comp.to_long(out, above=-1.0)


@query
def objective_matrix(spark, d):
    """All thirteen objectives."""
    out = screen.objective_matrix(V.feature_table(spark, d), list(K.OBJECTIVES))
    return out.withColumn("f_icorr", F.round("f_icorr", 9))


@query
def pareto_front(spark, d):
    """Small blocks, so that the comparison of blocks is what is checked."""
    return pareto.pareto_front(V.objective_points(spark, d), ["o1", "o2", "o3"], block_rows=16, best_rows=8)


@query
def pareto_rank(spark, d):
    """Every row with the number of its front; small cells, so that ranks pass from cell to cell."""
    return pareto.pareto_rank(V.objective_points(spark, d), ["o1", "o2", "o3"], cell_rows=64)


@query
def crowding_distance(spark, d):
    ranked = pareto.pareto_rank(V.objective_points(spark, d), ["o1", "o2", "o3"])
    out = pareto.crowding_distance(ranked, ["o1", "o2", "o3"])
    return out.select("id", "pareto_rank", F.round("crowding", 9).alias("crowding"))


FRONT_OBJECTIVES = ["Hardness", "Yield Strength", "Ecorr", "Epit", "FCC"]


@query
def front_pairs(spark, d):
    pairs = screen.front_pairs(FRONT_OBJECTIVES)
    columns = {o: K.OBJECTIVES[o][2] for o in FRONT_OBJECTIVES}
    return screen.front_views(prepared(spark, d), pairs, columns)


# --- models -------------------------------------------------------------------------
# The published settings (100 trees, depth 50 there, 30 here; 50 trees of 20 levels for imputation) are the defaults of the operators
# and what `rf_regress`, `batch_score`, `rf_classify` and `chained_impute` grow. The other queries fit every target, fold and round on
# all rows as well and grow smaller forests, the nested imputations the smallest.
# A prediction is no SQL value, so each query returns what SQL can decide about it for every row: keys, labels, counts,
# cells that must not change, whether a prediction lies in the range of the labels it was learned from, as a forest's
# must, and whether the model explains those labels better than a constant could (`learned`).

SMALL = models.Forest(trees=10, depth=8, bins=32, partitions=8)
SMALL_PHASE = models.Forest(trees=10, depth=8, bins=32, seed=4, partitions=8)
TINY = models.Forest(trees=3, depth=4, bins=32, partitions=4)

V58, V66 = "features_58", "features_66"
SPECS = models.family_a(V58, V66)


MODEL_COLUMNS = ["row_id", "domain", "electrolyte", *K.TARGETS, *K.CORR_FEATURES]


def _model_columns(spark, d):
    return V.feature_table(spark, d).select(*MODEL_COLUMNS)


def _with_vectors(table):
    """Targets, phase labels as given and the two feature vectors of every alloy."""
    labels = {f"_label_{p}": F.col(p) for p in K.PHASE_FLAGS}
    table = models.with_vectors(table.withColumns(labels))
    return table.withColumns({p: F.col(f"_label_{p}") for p in K.PHASE_FLAGS}).drop(*labels)


def _stored_features(spark, d):
    """The vectors computed once; a query that reads the columns as well stores those instead."""
    return stored(_with_vectors(_model_columns(spark, d)))


def _ranges(table: DataFrame) -> dict[str, tuple[float, float]]:
    """Label range of the training rows of each target."""
    parts = [s.rows(table).agg(F.lit(s.target).alias("t"), F.min(s.target).alias("lo"), F.max(s.target).alias("hi")) for s in SPECS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return {r["t"]: (r["lo"], r["hi"]) for r in out.collect()}


def _scored(table: DataFrame) -> tuple[DataFrame, dict[str, bool]]:
    """The table with `<target>_guess` of every row, stored, and which targets' guesses explain the labels learned from: an R² a
    constant cannot have."""
    family = models.train_family(table, SPECS, models.REGRESSOR)
    for vector in (V58, V66):
        table = models.predict(table, {f"{s.target}_guess": family[s.target] for s in SPECS if s.features == vector}, vector)
    table = stored(table)
    parts = [evaluate.r2_score(s.rows(table), s.target, f"{s.target}_guess", []).withColumn("t", F.lit(s.target)) for s in SPECS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return table, {r["t"]: r["r2"] is not None and r["r2"] > 0.01 for r in out.collect()}


def _in_range(ranges: dict, column: str, target: str):
    low, high = ranges[target]
    return F.coalesce(F.col(column).between(low - 1e-9 * abs(low), high + 1e-9 * abs(high)), F.lit(False))


def _count(conditions):
    out = F.lit(0)
    for c in conditions:
        out = out + F.when(c, 1).otherwise(0)
    return out


@query
def rf_regress(spark, d):
    """A forest per target, every row scored: the label and whether the prediction lies among those learned from."""
    table = _stored_features(spark, d)
    ranges, (out, learned) = _ranges(table), _scored(table)
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.round(t, 9).alias("truth"), _in_range(ranges, f"{t}_guess", t).alias("in_range"),
                               F.lit(learned[t]).alias("learned")) for t in K.TARGETS])
    return out.select("row_id", F.inline(cells))


@query
def rf_classify(spark, d):
    """A classifier per phase, on the held-out rows against the answer a constant would do best with."""
    table = _stored_features(spark, d)
    scores = []
    for p, (_, score) in zip(K.PHASE_FLAGS, models.holdout_accuracies(table, K.PHASE_FLAGS, V58, models.CLASSIFIER), strict=True):
        share = split.with_holdout(table.where(F.col(p).isNotNull())).where("is_test").agg(F.avg(F.col(p).cast("double")).alias("share"))
        scores.append(score.select("phase", "n", F.col("accuracy") - F.greatest(share.scalar(), F.lit(1) - share.scalar()).alias("gain")))
    out = scores[0]
    for score in scores[1:]:
        out = out.unionByName(score)
    return out.toDF("phase", "n", "gain").select("phase", "n", (F.col("gain") > 0).alias("better_than_chance"))


@query
def cv_r2(spark, d):
    """Five folds of every target."""
    scores = models.cv_r2(_stored_features(spark, d), SPECS, forest=SMALL)
    return scores.select("property", "n", F.coalesce(F.col("r2") <= 1, F.lit(False)).alias("scored"))


@query
def chained_impute(spark, d):
    """Five rounds over all features and targets: observed cells as they were, and no gap left."""
    cols = [*K.CORR_FEATURES, *K.TARGETS]
    table = stored(V.feature_table(spark, d).select("row_id", *cols))
    filled = impute.ChainedImputer(cols, rounds=5, forest=impute.IMPUTER_FOREST).fit_transform(table)[1]
    seen = table.select(F.col("row_id").alias("_id"), *[F.col(t).isNotNull().alias(f"_seen_{t}") for t in K.TARGETS])
    both = filled.join(seen, filled["row_id"] == seen["_id"])
    gaps = _count([F.col(t).isNull() for t in K.TARGETS])
    return both.select("row_id", *[F.round(F.when(F.col(f"_seen_{t}"), F.col(t)), 9).alias(t) for t in K.TARGETS], gaps.alias("n_gaps"))


@query
def nested_cv_r2(spark, d):
    """Five folds, five imputation rounds in each, every target."""
    scores = impute.nested_cv_r2(V.feature_table(spark, d), K.TARGETS, folds=5, rounds=5, forest=TINY, imputer_forest=TINY)
    return scores.select("target", "n", F.coalesce(F.col("r2") <= 1, F.lit(False)).alias("scored"))


@query
def batch_score(spark, d):
    """Seven regressors in one pass over the table."""
    table = _stored_features(spark, d)
    ranges, (out, learned) = _ranges(table), _scored(table)
    return out.select("row_id", _count([_in_range(ranges, f"{t}_guess", t) for t in K.TARGETS]).alias("n_in_range"),
                      F.lit(sum(learned.values())).alias("n_learned"))


@query
def phase_probability(spark, d):
    """Phase probabilities of features whose phase slots are empty, as a candidate's are."""
    table = stored(_model_columns(spark, d))
    phases = {f"{p}_flag": m for p, m in models.train_phases(_with_vectors(table), SMALL_PHASE, V58).items()}
    blank = table.withColumns({p: F.lit(0.0) for p in K.PHASE_FLAGS})
    out = models.predict(blank, phases, K.MECH_FEATURES, probability=True)
    return out.select("row_id", _count([F.col(f"{p}_probability").between(0, 1) for p in phases]).alias("n_probabilities"))


@query
def two_stage_score(spark, d):
    """Phases from empty slots, then every target from features that hold those phases."""
    table = stored(_model_columns(spark, d))
    vectors = _with_vectors(table)
    family = models.Family(models.train_family(vectors, SPECS, SMALL), models.train_phases(vectors, SMALL_PHASE, V58))
    ranges, out = _ranges(vectors), models.two_stage_score(table, family, phase_objectives=True)
    flags = [F.col(c).isin(0.0, 1.0) for p in K.PHASE_FLAGS for c in (p, f"{p}_objective")]
    return out.select("row_id", _count(flags).alias("n_flags"), _count([_in_range(ranges, t, t) for t in K.TARGETS]).alias("n_in_range"))


@query
def screen_report(spark, d):
    """The search from end to end: vectors decoded with the bounds of the alloys, constrained, scored in two stages by models
    trained on the alloys, reduced to the front, reported."""
    vectors = _stored_features(spark, d)
    family = models.Family(models.train_family(vectors, SPECS, SMALL), models.train_phases(vectors, SMALL_PHASE, V58))
    amounts = stored(screen.decode(V.candidates(spark, d), profile.bounds_row(V.wide(spark, d))))
    request = screen.ScreenRequest(max_elements=len(K.ELEMENTS), objectives=("Density", "Aluminum Content"))
    out = W.screen_candidates(amounts, family, request, "NaCl", 0.6)
    return out.select("row_id", "n_elements", "process", F.round("composition_sum", 2).alias("composition_sum"),
                      (F.col("fcc_probability").between(0, 1) & F.col("hardness").isNotNull()).alias("scored"))
