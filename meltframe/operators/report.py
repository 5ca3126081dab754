"""Result tables: imputed export, screen report, metrics, union of model families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.functions import columns as C
from meltframe.functions import text
from meltframe.operators import composition as comp

# column here -> display name in the screen report, in order
REPORT_COLUMNS = {
    "composition": "Alloy Composition",
    "n_elements": "N Elements",
    "process": "Processing Method",
    "phase": "Predicted Phase",
    "hardness": "Hardness (HV)",
    "tensile_mpa": "Tensile Strength (MPa)",
    "yield_mpa": "Yield Strength (MPa)",
    "elongation_pct": "Elongation (%)",
    "ecorr_mv": "Ecorr (mV vs SCE)",
    "epit_mv": "Epit (mV vs SCE)",
    "icorr": "icorr (µA/cm²)",
    "density": "Density (g/cm³)",
    "fcc_probability": "FCC probability",
    "bcc_probability": "BCC probability",
    "hcp_probability": "HCP probability",
    "im_probability": "IM probability",
    "al_fraction": "Al molar fraction",
    "composition_sum": "Composition sum",
}
EXPORT_NAMES = {
    "ecorr_mv": "Ecorr mV vs SCE",
    "epit_mv": "Epit mV vs SCE",
}


def with_observed_flags(df: DataFrame) -> DataFrame:
    """`<target>_observed` flags, to be taken before imputation; they ride along in the row.

    The flag of the current density looks at its log column: a value that cannot be logged was not observed.
    """
    return df.withColumns({f"{t}_observed": C.observed(t) for t in K.TARGETS})


def imputed_export(imputed: DataFrame, key: str = "row_id") -> DataFrame:
    """Imputed targets, clipped and rounded, beside the flags that tell observed cells from estimates."""
    digits = {t: 3 for t in K.MECH_TARGETS} | {"ecorr_mv": 2, "epit_mv": 2, "icorr_log10": 4}
    log = C.clip_to_rule("icorr_log10")
    return imputed.select(
        key, "domain", "composition",
        *[F.bround(C.clip_to_rule(t), digits[t]).alias(f"{t}_imputed") for t in K.TARGETS],
        F.bround(F.pow(F.lit(10.0), log), 4).alias("icorr_imputed"),
        *[f"{t}_observed" for t in K.TARGETS],
    )


def export_display(df: DataFrame) -> DataFrame:
    """The 17 columns of the export under their display names."""
    names = {"domain": "OG property", "composition": "Composition"}
    names |= {f"{t}_imputed": f"{K.TARGET_LABELS[t]} (imputed)" for t in K.MECH_TARGETS}
    names |= {f"{t}_imputed": f"{v} (imputed)" for t, v in EXPORT_NAMES.items()}
    names |= {"icorr_log10_imputed": "icorr log10 (imputed)", "icorr_imputed": "icorr µA/cm² (imputed)"}
    names |= {f"{t}_observed": f"{K.TARGET_LABELS[t]} (observed?)" for t in K.MECH_TARGETS}
    names |= {"ecorr_mv_observed": "Ecorr (observed?)", "epit_mv_observed": "Epit (observed?)",
              "icorr_log10_observed": "icorr (observed?)"}
    return df.select(*[F.col(c).alias(d) for c, d in names.items()])


def screen_report(scored: DataFrame, key: str = "row_id") -> DataFrame:
    """Display columns of scored candidates.

    Expects the element amounts, `process_scores`, the seven predictions (`icorr_log10` as log), the phase
    flags `fcc..im` and `fcc_probability..im_probability`.
    """
    out = comp.with_total(scored).withColumn("_present", comp.present_shares())
    al = F.coalesce(
        F.get(F.filter("_present", lambda t: t["elem_idx"] == K.ELEMENT_INDEX["Al"]), F.lit(0))["share"], F.lit(0.0)
    )
    total = F.aggregate("_present", F.lit(0.0), lambda acc, t: acc + t["share"])
    probabilities = [f"{p}_probability" for p in K.PHASE_FLAGS]
    out = out.select(
        key,
        text.composition_string(F.col("_present")).alias("composition"),
        F.size("_present").alias("n_elements"),
        text.process_label(text.first_max(F.col("process_scores")) + 1).alias("process"),
        text.phase_label([F.col(p) for p in K.PHASE_FLAGS], [F.col(p) for p in probabilities]).alias("phase"),
        *[F.bround(t, 2).alias(t) for t in [*K.MECH_TARGETS, "ecorr_mv", "epit_mv"]],
        F.bround(C.icorr_from_log(F.col("icorr_log10")), 4).alias("icorr"),
        # the share of nothing has no density
        F.bround(F.nullif(comp.density(), F.lit(0.0)), 3).alias("density"),
        *[F.bround(p, 3).alias(p) for p in probabilities],
        F.bround(al, 4).alias("al_fraction"),
        F.bround(total, 4).alias("composition_sum"),
    )
    return out.select(key, *REPORT_COLUMNS)


def report_display(report: DataFrame, hide: bool = True) -> DataFrame:
    """Display names; the helper columns are left out of the table shown and kept in the download."""
    named = report.select(*[F.col(c).alias(d) for c, d in REPORT_COLUMNS.items()])
    return named.drop(*K.HIDDEN_COLUMNS) if hide else named


def metrics_report(summary: DataFrame) -> DataFrame:
    """Score lines: short property name and R² with three digits."""
    return summary.select(
        text.short_name(F.col("property")).alias("property"), "model_family", F.bround("r2", 3).alias("r2"),
        F.bround("std", 3).alias("std"), "n",
    )


def results_union(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several model families in one table."""
    frames = [df.withColumn("model_family", F.lit(name)) for name, df in results.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
