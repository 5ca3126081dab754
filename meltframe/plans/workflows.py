"""The working steps end to end: prepare the alloy table, train both model families, screen candidates.

Every step takes and returns tables (see `sources.tables` for reading and writing them); `row_id` is the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.functions import columns as C
from meltframe.functions import text as T
from meltframe.operators import composition as comp
from meltframe.operators import evaluate, impute, models, pareto, profile, report, screen
from meltframe.operators.models import CLASSIFIER, REGRESSOR, Forest
from meltframe.session import stored


def fill_parameters(alloys: DataFrame) -> DataFrame:
    """Parameters of the corrosion rows computed from their composition; the other rows keep theirs.

    Computed in the row itself, so the write-back needs no join.
    """
    mask = F.col("domain") == "corrosion"
    held = alloys.withColumnsRenamed({n: f"_old_{n}" for n in K.EMPIRICAL})
    amounts = held.withColumns({f"_raw_{e}": F.col(e) for e in K.ELEMENTS})
    fresh = comp.round_params(comp.with_params(amounts))
    return fresh.select(
        *[F.col(f"_raw_{c}").alias(c) if c in K.ELEMENT_INDEX
          else C.update_where(mask, F.col(c), F.col(f"_old_{c}")).alias(c) if c in K.EMPIRICAL
          else F.col(c) for c in alloys.columns]
    )


def harmonise_processing(alloys: DataFrame) -> DataFrame:
    """Process flags of the corrosion rows from their free-text note; the other rows keep theirs."""
    mask = F.col("domain") == "corrosion"
    code = F.when(mask, T.process_class(F.col("processing_text")))
    flagged = alloys.withColumn("_class", code)
    updates = {n: C.update_where(mask, c, F.col(n)) for n, c in C.process_flags("_class").items()}
    return flagged.withColumns(updates).drop("_class")


def prepare(alloys: DataFrame, check: bool = True) -> DataFrame:
    """Parameters and process flags completed; the check fails the job if a corrosion row has not exactly one flag.

    With the check the table is computed and stored by one job, which counts such rows as it writes.
    """
    ready = harmonise_processing(fill_parameters(alloys))
    return profile.stored_one_hot(ready, F.col("domain") == "corrosion") if check else ready


def model_inputs(prepared: DataFrame) -> DataFrame:
    """Targets with zeros as missing, log current density and test-environment features added."""
    return C.add_test_environment(C.prepare_targets(prepared))


@dataclass
class Training:
    """Models of a family with their scores: R² per property, accuracy per phase."""

    family: models.Family
    metrics: DataFrame
    accuracies: DataFrame


def _phases(table: DataFrame, forest: Forest) -> tuple[dict, DataFrame]:
    both = models.holdout_accuracies(table, K.PHASE_FLAGS, "features_58", forest)
    return {p: model for p, (model, _) in zip(K.PHASE_FLAGS, both, strict=True)}, reduce(DataFrame.unionByName, [s for _, s in both])


def train_separate(inputs: DataFrame, forest: Forest = REGRESSOR, phase_forest: Forest = CLASSIFIER,
                   folds: int = 5) -> Training:
    """Family A: one model per target on its observed rows, cross-validated; nothing is imputed."""
    # the labels as given: the vectors fill a missing phase with 0, which is a feature and no label
    labels = {f"_label_{p}": F.col(p) for p in K.PHASE_FLAGS}
    table = stored(models.with_vectors(inputs.withColumns(labels)).withColumns({p: F.col(f"_label_{p}") for p in K.PHASE_FLAGS}))
    specs = models.family_a("features_58", "features_66")
    metrics = models.cv_r2(table, specs, folds, forest).withColumn("model_family", F.lit("A"))
    phases, accuracies = _phases(table, phase_forest)
    return Training(models.Family(models.train_family(table, specs, forest), phases), metrics, accuracies)


def train_imputed(inputs: DataFrame, forest: Forest = REGRESSOR, phase_forest: Forest = CLASSIFIER,
                  imputer_forest: Forest = impute.IMPUTER_FOREST, rounds: int = 5, folds: int = 5,
                  scored: Sequence[str] = tuple(K.TARGETS)) -> tuple[Training, impute.ImputerModel, DataFrame]:
    """Family B: every target imputed, then one model per target on all rows; scored by nested cross-validation.

    Returns the training, the imputer and the export of the imputed table. `scored` names the targets that go
    through the nested cross-validation.
    """
    cols = [*K.CORR_FEATURES, *K.TARGETS]
    keep = ["row_id", "domain", "composition", *[f"{t}_observed" for t in K.TARGETS]]
    # the phase labels as given: a missing one is imputed as a feature but trains no classifier
    labels = {f"_label_{p}": F.col(p) for p in K.PHASE_FLAGS}
    flagged = report.with_observed_flags(inputs).withColumns(labels).select(*keep, *labels, *cols)
    source = stored(flagged)
    imputer, filled = impute.ChainedImputer(cols, rounds=rounds, forest=imputer_forest).fit_transform(source)
    export = report.imputed_export(filled)
    clipped = filled.withColumns({t: C.clip_to_rule(t) for t in K.TARGETS})
    table = stored(models.with_vectors(clipped))
    regressors = models.train_family(table, models.family_b("features_66"), forest)
    real = table.withColumns({p: F.col(f"_label_{p}") for p in K.PHASE_FLAGS})
    phases, accuracies = _phases(real, phase_forest)
    scores = impute.nested_cv_r2(source, list(scored), folds=folds, rounds=rounds, forest=forest,
                                 imputer_forest=imputer_forest)
    names = F.create_map(*[F.lit(v) for kv in K.TARGET_LABELS.items() for v in kv])
    metrics = scores.select(F.try_element_at(names, F.col("target")).alias("property"), "r2", "std", "n",
                            F.lit("B").alias("model_family"))
    family = models.Family(regressors, phases, mech_features=list(K.CORR_FEATURES))
    return Training(family, metrics, accuracies), imputer, export


def screen_candidates(candidates: DataFrame, family: models.Family, request: screen.ScreenRequest, electrolyte: str,
                      concentration_m: float) -> DataFrame:
    """Report of the feasible, non-dominated candidates.

    `candidates` holds raw element amounts and `process_scores` per `row_id`. Infeasible rows go before anything is
    scored. As published, objectives are taken from the raw amounts, the report from the renormalised ones.
    """
    feasible = stored(screen.violations(candidates, request).where("feasible").select(*candidates.columns))

    def scored(amounts: DataFrame, **options) -> DataFrame:
        ready = models.process_from_scores(comp.with_params(amounts))
        return models.two_stage_score(models.environment(ready, electrolyte, concentration_m), family, **options)

    raw = scored(feasible, phase_objectives=True)
    columns = {p: f"{p.lower()}_objective" for p in K.PHASES} | {"Aluminum Content": "Al"}
    wanted = {o: c for o, c in columns.items() if o in request.objectives}
    objectives = stored(screen.objective_matrix(raw, request.objectives, columns=wanted))
    names = [screen.objective_column(o) for o in request.objectives]
    front = pareto.pareto_front(objectives, names).select("row_id")
    chosen = feasible.join(front, "row_id", "left_semi")
    return report.screen_report(scored(stored(comp.shares_wide(chosen))))


def compare(*trainings: Training) -> DataFrame:
    """R² of the families side by side."""
    out = trainings[0].metrics
    for t in trainings[1:]:
        out = out.unionByName(t.metrics)
    return evaluate.compare_families(out)
