"""DuckDB SQL with the same answers as the catalog, written over the long form with joins and grouped sums."""

from __future__ import annotations

from meltframe import constants as K
from meltframe.plans.views import PHRASES_SQL, RECORD_SQL

ORACLE: dict[str, str] = {}

# --- shared table expressions ---------------------------------------------------------

RECORD = "record AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in RECORD_SQL.items()) + " FROM orders)"
PHRASES = f"phrases AS (SELECT * FROM (VALUES {PHRASES_SQL}) AS p(phrase_id, phrase, expected_class))"
COMP = """comp AS (SELECT l_orderkey AS row_id, CAST(l_partkey % 32 AS INTEGER) AS elem_idx,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS amount FROM lineitem GROUP BY 1, 2)"""
TOT = "tot AS (SELECT row_id, CAST(SUM(amount) AS BIGINT) AS w FROM comp GROUP BY row_id)"
SHARES = "shares AS (SELECT row_id, elem_idx, amount, w, CAST(amount AS DOUBLE) / w AS x FROM comp JOIN tot USING (row_id))"
PROPS = "props AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{e}', " + ", ".join(str(K.SCALED[p][i]) for p in K.PROPERTIES) + ")" for i, e in enumerate(K.ELEMENTS)
) + ") AS t(elem_idx, elem, " + ", ".join(K.PROPERTIES) + "))"
PAIRS = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {h})" for a, b, h in K.PAIRS) + ") AS t(e1, e2, h))"
TARGET_COLS = {t: f"NULLIF({t}, 0)" for t in K.RAW_TARGETS}
PREPARED = "prepared AS (SELECT * REPLACE (" + ", ".join(f"{v} AS {t}" for t, v in TARGET_COLS.items()) + """),
  CASE WHEN icorr > 0 THEN log10(icorr) END AS icorr_log10 FROM record)"""
CAND = """cand AS (SELECT vec_id AS row_id, CAST(i - 1 AS INTEGER) AS elem_idx,
  CAST(FLOOR(ABS(CAST(embedding[i] AS DOUBLE)) * 1000000) + COALESCE(FLOOR(ABS(CAST(embedding[i + 39] AS DOUBLE)) * 1000000), 0) AS BIGINT)
  AS raw FROM embeddings, range(1, 40) AS r(i))"""


def _matches(cls: int) -> str:
    keywords = dict(K.PROCESSING_RULES)[cls]
    return " OR ".join(f"contains(v, '{k}')" for k in keywords)


def class_sql(note: str) -> str:
    whens = " ".join(f"WHEN {_matches(cls)} THEN {cls}" for cls in (7, 6, 4, 5, 3, 2))
    return (
        f"(SELECT CASE WHEN v IS NULL OR v IN ('0', '', 'missing', 'nan') THEN 1 {whens} ELSE 1 END "
        f"FROM (SELECT lower(trim({note})) AS v))"
    )


NOTED = f"noted AS (SELECT r.*, p.phrase, {class_sql('p.phrase')} AS process_class FROM record r LEFT JOIN phrases p USING (phrase_id))"

# Means in scaled units first, then deviations: lists keep the element order fixed.
_DEV = {p: f"list_sum(list(a * (({p} - {p}_s / w) * ({p} - {p}_s / w)) ORDER BY elem_idx))" for p in ("tm", "chi", "vec", "bulk")}
PARAMS = f"""joined AS (SELECT row_id, CAST(amount AS DOUBLE) AS a, props.* FROM comp JOIN props USING (elem_idx)),
sums AS (SELECT row_id, SUM(a) AS w, {", ".join(f"SUM(a * {p}) AS {p}_s" for p in K.PROPERTIES)}, SUM(a * ln(a)) AS xlnx
  FROM joined GROUP BY row_id),
devs AS (SELECT row_id, {", ".join(f"{e} AS {p}_d" for p, e in _DEV.items())},
  list_sum(list(a * ((1 - radius / (radius_s / w)) * (1 - radius / (radius_s / w))) ORDER BY elem_idx)) AS radius_d
  FROM joined JOIN sums USING (row_id) GROUP BY row_id),
pair_terms AS (SELECT l.row_id, SUM(l.a * r.a * h) AS h1, SUM((l.a * r.a * h) * (l.a * r.a * h)) AS h2
  FROM joined l JOIN joined r ON l.row_id = r.row_id AND l.elem_idx < r.elem_idx
  JOIN pairs ON e1 = l.elem AND e2 = r.elem GROUP BY l.row_id),
raw_params AS (SELECT row_id, w, lattice_s / (w * 100) AS a, 100 * sqrt(radius_d / w) AS delta,
  tm_s / w AS tm, sqrt(tm_d / w) AS tm_std, {K.R_GAS} * (ln(w) - xlnx / w) AS entropy,
  COALESCE(4 * h1 / (w * w), 0) AS enthalpy, COALESCE(4 * sqrt(h2) / (w * w), 0) AS enthalpy_spread,
  chi_s / (w * 100) AS chi, sqrt(chi_d / w) / 100 AS chi_std, vec_s / w AS vec, sqrt(vec_d / w) AS vec_std,
  bulk_s / w AS bulk, sqrt(bulk_d / w) AS bulk_std, mass_s / volume_s AS density
  FROM sums JOIN devs USING (row_id) LEFT JOIN pair_terms USING (row_id)),
params AS (SELECT row_id, a, delta, tm, tm_std, round(entropy, 6) AS entropy, enthalpy, enthalpy_spread,
  round(CASE WHEN enthalpy <> 0 THEN tm * entropy / (abs(enthalpy) * 1000) ELSE 0 END, 6) AS omega,
  chi, chi_std, vec, vec_std, bulk, bulk_std, density FROM raw_params)"""
ALL_PARAMS = f"WITH {COMP}, {PROPS}, {PAIRS}, {PARAMS} "
WIDE = "wide AS (SELECT row_id, " + ", ".join(
    f'CAST(SUM(CASE WHEN elem_idx = {i} THEN amount ELSE 0 END) AS DOUBLE) AS "{e}"' for i, e in enumerate(K.ELEMENTS)
) + " FROM comp GROUP BY row_id)"
FLAGS = ", ".join(f"CASE WHEN process_class = {i} THEN 1 ELSE 0 END AS process_{i}" for i in range(1, 8))
MEDIA = ", ".join(
    f"CASE WHEN electrolyte = '{m}' THEN 1 ELSE 0 END AS {n}" for m, n in zip(K.ELECTROLYTES, K.ELECTROLYTE_FLAGS)
)


def add(name: str, ctes: list[str], select: str) -> None:
    ORACLE[name] = ("WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else "") + select


# --- scans, projections ---------------------------------------------------------------

ORACLE["scan_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_missing, "
    f"CAST(MIN({c}) AS DOUBLE) AS low, CAST(MAX({c}) AS DOUBLE) AS high FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
add("electrolyte_onehot", [RECORD], f"SELECT row_id, {MEDIA} FROM record")
add("process_onehot", [RECORD, PHRASES, NOTED], f"SELECT row_id, {FLAGS} FROM noted")
add("conc_norm", [RECORD], "SELECT row_id, COALESCE(concentration_m, 0) / 6.0 AS conc_norm FROM record")
add("zero_as_missing", [RECORD], "SELECT row_id, " + ", ".join(f"{v} AS {t}" for t, v in TARGET_COLS.items()) + " FROM record")
add("log10_positive", [RECORD], "SELECT row_id, CASE WHEN icorr > 0 THEN round(log10(icorr), 9) END AS icorr_log10 FROM record")
ORACLE["icorr_backtransform"] = """SELECT o_orderkey AS row_id,
  round(least(greatest(pow(10, o_totalprice / 50000 - 3), 0), 1000000), 4) AS icorr FROM orders"""
_CLIPPED = {
    t: f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} < {lo} THEN {lo}::DOUBLE WHEN {t} > {hi} THEN {hi}::DOUBLE ELSE {t} END"
    for t, (lo, hi) in K.CLIP_RULES.items()
}
add("clip_rules", [RECORD, PREPARED], "SELECT row_id, " + ", ".join(
    f"round({e}, 9) AS {t}" if t == "icorr_log10" else f"{e} AS {t}" for t, e in _CLIPPED.items()) + " FROM prepared")
add("fill_zero", [RECORD], """SELECT row_id, COALESCE(concentration_m, 0) AS concentration_m,
  COALESCE(hardness, 0) AS hardness FROM record""")
add("observed_flags", [RECORD, PREPARED], "SELECT row_id, " + ", ".join(
    f"CASE WHEN {t} IS NULL THEN 0 ELSE 1 END AS {t}_observed" for t in K.TARGETS) + " FROM prepared")
add("masked_update", [RECORD, COMP, PROPS], """, dens AS (SELECT row_id, CAST(SUM(amount * mass) AS DOUBLE) / SUM(amount * volume) AS d
  FROM comp JOIN props USING (elem_idx) GROUP BY row_id)
  SELECT row_id, domain, CASE WHEN domain = 'corrosion' THEN COALESCE(d, 0) ELSE CAST(fcc AS DOUBLE) END AS density
  FROM record LEFT JOIN dens USING (row_id)""")
add("display_projection", [RECORD], f"""SELECT row_id, domain AS "OG property",
  hardness AS "{K.TARGET_LABELS['hardness']} (observed)", icorr AS "{K.TARGET_LABELS['icorr']} (observed)" FROM record""")
_FEATURE_ROWS = [RECORD, PHRASES, NOTED, COMP, PROPS, PAIRS, PARAMS, WIDE,
                 f"flagged AS (SELECT *, {FLAGS}, {MEDIA}, COALESCE(concentration_m, 0) / 6.0 AS conc_norm FROM noted)"]


def _feature_list(names: list[str]) -> str:
    return ", ".join(f'COALESCE(CAST("{n}" AS DOUBLE), 0) AS "{n}"' for n in names)


for _name, _cols in (("features_58", K.MECH_FEATURES), ("features_66", K.CORR_FEATURES)):
    add(_name, _FEATURE_ROWS, f"SELECT row_id, {_feature_list(_cols)} FROM flagged LEFT JOIN wide USING (row_id) LEFT JOIN params USING (row_id)")

# --- filters --------------------------------------------------------------------------

add("domain_filter", [RECORD], "SELECT row_id, hardness FROM record WHERE domain = 'mechanical'")
_MEDIA_LIST = ", ".join(f"'{m}'" for m in K.ELECTROLYTES)
add("electrolyte_filter", [RECORD], f"SELECT row_id, electrolyte FROM record WHERE domain = 'corrosion' AND electrolyte IN ({_MEDIA_LIST})")
add("labelled_rows", [RECORD], "SELECT row_id, hardness FROM record WHERE hardness IS NOT NULL AND hardness <> 0")
add("min_support", [RECORD, PREPARED], """SELECT electrolyte, COUNT(icorr_log10) AS n_observed FROM prepared
  WHERE domain = 'corrosion' GROUP BY electrolyte HAVING COUNT(icorr_log10) >= 25""")


def _share_of(e: str) -> str:
    return f"COALESCE(MAX(CASE WHEN elem_idx = {K.ELEMENT_INDEX[e]} THEN x END), 0)"


_V = {
    "v_max_elements": "CAST(SUM(CASE WHEN x > 0.005 THEN 1 ELSE 0 END) - 4 AS DOUBLE)",
    **{f"v_banned_{e}": f"{_share_of(e)} - 0.005::DOUBLE" for e in ("Ca", "Nd", "Re")},
    "v_required_Al": f"0.005::DOUBLE - {_share_of('Al')}",
    "v_max_fraction": "MAX(x) - 0.6::DOUBLE",
}
VIOL = "viol AS (SELECT row_id, " + ", ".join(f"{e} AS {n}" for n, e in _V.items()) + " FROM shares GROUP BY row_id)"
_SHARED = [COMP, TOT, SHARES]
add("constraint_max_elements", [*_SHARED, VIOL], "SELECT row_id, v_max_elements FROM viol")
add("constraint_banned", [*_SHARED, VIOL], 'SELECT row_id, "v_banned_Ca", "v_banned_Nd", "v_banned_Re" FROM viol')
add("constraint_required", [*_SHARED, VIOL], 'SELECT row_id, "v_required_Al" FROM viol')
add("constraint_max_fraction", [*_SHARED, VIOL], "SELECT row_id, v_max_fraction FROM viol")
add("feasibility", [*_SHARED, VIOL], f"""SELECT *, round({" + ".join(f'greatest({n}, 0)' for n in _V)}, 9) AS total_violation,
  {" AND ".join(f'{n} <= 0' for n in _V)} AS feasible FROM viol""")
STRINGS = """kept AS (SELECT row_id, elem_idx, amount FROM shares WHERE x > 0.005),
kept_tot AS (SELECT row_id, SUM(amount) AS kw FROM kept GROUP BY row_id),
parts AS (SELECT row_id, elem_idx, elem, CAST(round_even(CAST(amount AS DOUBLE) / kw * 1000, 0) AS INTEGER) AS m
  FROM kept JOIN kept_tot USING (row_id) JOIN props USING (elem_idx)),
strings AS (SELECT row_id, string_agg(elem || CAST(m // 1000 AS VARCHAR) || '.' || lpad(CAST(m % 1000 AS VARCHAR), 3, '0'), ''
  ORDER BY elem_idx) AS composition FROM parts GROUP BY row_id)"""
add("composition_string", [*_SHARED, PROPS, STRINGS], "SELECT row_id, composition FROM strings")
add("composition_parse", [*_SHARED, PROPS, STRINGS], "SELECT row_id, elem, CAST(m AS DOUBLE) / 1000 AS share FROM parts")
add("banned_string_filter", [*_SHARED, PROPS, STRINGS], """SELECT row_id, composition FROM strings
  WHERE row_id NOT IN (SELECT row_id FROM parts WHERE elem IN ('C', 'N', 'V') AND m > 5)""")
add("banned_complement", [PROPS], """, totals AS (SELECT CAST(l_partkey % 32 AS INTEGER) AS elem_idx, SUM(l_quantity) AS total
  FROM lineitem GROUP BY 1)
  SELECT elem_idx, elem FROM props WHERE elem_idx NOT IN
  (SELECT elem_idx FROM totals WHERE total > (SELECT AVG(total) FROM totals))""")

# --- lookups --------------------------------------------------------------------------

add("element_lookup", [COMP, PROPS], "SELECT elem_idx, row_id, amount, elem, " + ", ".join(
    f"CAST({p} AS DOUBLE) / {K.SCALE[p]} AS {p}" for p in K.PROPERTIES) + " FROM comp JOIN props USING (elem_idx)")
_PAIR_ROWS = """SELECT l.row_id, pl.elem AS e1, pr.elem AS e2, CAST(l.amount AS DOUBLE) AS amount1, CAST(r.amount AS DOUBLE) AS amount2
  FROM comp l JOIN comp r ON l.row_id = r.row_id AND l.elem_idx < r.elem_idx
  JOIN props pl ON pl.elem_idx = l.elem_idx JOIN props pr ON pr.elem_idx = r.elem_idx"""
add("element_pairs", [COMP, PROPS], _PAIR_ROWS)
add("pair_enthalpy", [COMP, PROPS, PAIRS], f"""SELECT row_id, e1, e2, CAST(COALESCE(h, 0) AS DOUBLE) AS h
  FROM ({_PAIR_ROWS}) LEFT JOIN pairs USING (e1, e2)""")
MEANS = "means AS (SELECT " + ", ".join(f"AVG({t}) AS {t}_mean" for t in K.TARGETS) + " FROM prepared)"
FILLED = "filled AS (SELECT row_id, " + ", ".join(f"COALESCE({t}, {t}_mean) AS {t}" for t in K.TARGETS) + " FROM prepared, means)"
add("mean_impute", [RECORD, PREPARED, MEANS, FILLED], "SELECT row_id, " + ", ".join(f"round({t}, 6) AS {t}" for t in K.TARGETS) + " FROM filled")
add("observed_vs_imputed", [RECORD, PREPARED, MEANS, FILLED], " UNION ALL ".join(
    f"""SELECT '{t}' AS "column", '{kind}' AS kind, COUNT({t}) AS n, round(MIN({t}), 6) AS low,
    round(MAX({t}), 6) AS high, round(AVG({t}), 6) AS mean FROM {source}"""
    for t in K.TARGETS for kind, source in (("observed", "prepared"), ("imputed", "filled"))))
_EXPORT_DIGITS = {t: 3 for t in K.MECH_TARGETS} | {"ecorr_mv": 2, "epit_mv": 2, "icorr_log10": 4}
add("imputed_export", [RECORD, PREPARED, MEANS, FILLED], "SELECT row_id, domain, CAST(NULL AS VARCHAR) AS composition, "
    + ", ".join(f"f.{t}_imputed" for t in K.TARGETS) + ", icorr_imputed, "
    + ", ".join(f"CASE WHEN p.{t} IS NULL THEN 0 ELSE 1 END AS {t}_observed" for t in K.TARGETS)
    + " FROM prepared p JOIN (SELECT row_id, "
    + ", ".join(f"round({e}, {_EXPORT_DIGITS[t]}) AS {t}_imputed" for t, e in _CLIPPED.items())
    + f", round(pow(10, {_CLIPPED['icorr_log10']}), 4) AS icorr_imputed FROM filled) f USING (row_id)")


def hash_sql(key: str, seed: object) -> str:
    return f"CAST('0x' || substring(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


add("kfold", [], f"SELECT o_orderkey AS row_id, CAST({hash_sql('o_orderkey', 42)} % 5 AS INTEGER) AS fold FROM orders")
add("kfold_exact", [], f"""SELECT o_orderkey AS row_id, CAST((row_number() OVER (ORDER BY {hash_sql('o_orderkey', 42)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
  FROM orders""")
add("holdout_exact", [], f"""SELECT o_orderkey AS row_id,
  row_number() OVER (ORDER BY {hash_sql('o_orderkey', 14)}, o_orderkey) <= ceil(0.1::DOUBLE * count(*) OVER ()) AS is_test FROM orders""")
add("holdout_split", [], f"SELECT o_orderkey AS row_id, {hash_sql('o_orderkey', 14)} < {int(0.1 * 2**32)} AS is_test FROM orders")
add("nontest_rows", [RECORD], f"""SELECT * FROM (SELECT row_id, domain,
  CAST({hash_sql('row_id', 42)} % 5 AS INTEGER) AS fold FROM record) WHERE fold <> 0""")
_LABELS = " ".join(f"WHEN {i} THEN '{label}'" for i, label in K.PROCESS_LABELS.items())
add("process_label", [RECORD, PHRASES, NOTED], f"""SELECT row_id, process_class, CASE process_class {_LABELS} ELSE 'Unknown' END AS process
  FROM (SELECT row_id, CASE WHEN domain = 'corrosion' THEN process_class END AS process_class FROM noted)""")

# --- composition aggregates -----------------------------------------------------------

add("fractions", _SHARED, "SELECT row_id, elem_idx, x AS fraction FROM shares")
add("weighted_means", [COMP, PROPS], "SELECT row_id, " + ", ".join(
    f"CAST(SUM(amount * {p}) AS DOUBLE) / (SUM(amount) * {K.SCALE[p]}) AS {p}" for p in K.PROPERTIES)
    + " FROM comp JOIN props USING (elem_idx) GROUP BY row_id")
for _name, _cols in {
    "weighted_stds": "tm_std, chi_std, vec_std, bulk_std", "size_mismatch": "delta", "mixing_entropy": "entropy",
    "mixing_enthalpy": "enthalpy", "enthalpy_spread": "enthalpy_spread", "omega": "omega",
    "empirical_params": ", ".join(K.EMPIRICAL),
}.items():
    ORACLE[_name] = f"{ALL_PARAMS} SELECT row_id, {_cols} FROM params"
add("mixture_density", [COMP, PROPS], """SELECT row_id, CAST(SUM(amount * mass) AS DOUBLE) / SUM(amount * volume) AS density
  FROM comp JOIN props USING (elem_idx) GROUP BY row_id""")
add("array_density", [CAND, PROPS], """SELECT row_id, CAST(SUM(raw * mass) AS DOUBLE) / SUM(raw * volume) AS density
  FROM cand JOIN props USING (elem_idx) GROUP BY row_id""")
add("n_elements", _SHARED, "SELECT row_id, CAST(SUM(CASE WHEN x > 0.005 THEN 1 ELSE 0 END) AS INTEGER) AS n_elements FROM shares GROUP BY row_id")
add("composition_summary", _SHARED, f"""SELECT row_id, CAST(SUM(CASE WHEN x > 0.005 THEN 1 ELSE 0 END) AS INTEGER) AS n_elements,
  MAX(x) AS max_fraction, {_share_of('Al')} AS al_fraction, 1.0::DOUBLE AS composition_sum FROM shares GROUP BY row_id""")

# --- profiles -------------------------------------------------------------------------

add("domain_counts", [RECORD], "SELECT domain, COUNT(*) AS n FROM record GROUP BY domain")
add("process_flag_sums", [RECORD, PHRASES, NOTED], "SELECT " + ", ".join(
    f"CAST(SUM(CASE WHEN process_class = {i} THEN 1 ELSE 0 END) AS BIGINT) AS process_{i}" for i in range(1, 8))
    + " FROM noted WHERE domain = 'corrosion'")
add("process_histogram", [RECORD, PHRASES, NOTED], """SELECT process_class, COUNT(*) AS n FROM noted
  WHERE domain = 'corrosion' GROUP BY process_class ORDER BY process_class""")
add("onehot_violations", [RECORD], "SELECT row_id, fcc, bcc, hcp, im FROM record WHERE fcc + bcc + hcp + im <> 1")
_MISSING = ["electrolyte", "concentration_m", *K.TARGETS]
add("missing_profile", [RECORD, PREPARED], " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS n_missing FROM prepared" for c in _MISSING]
    + ["SELECT '(total)', " + " + ".join(f"COUNT(*) - COUNT({c})" for c in _MISSING) + " FROM prepared"]))
add("composition_bounds", [COMP, PROPS], """SELECT elem, CASE WHEN COUNT(row_id) < (SELECT COUNT(DISTINCT row_id) FROM comp)
  THEN 0.0::DOUBLE ELSE CAST(MIN(amount) AS DOUBLE) END AS low, CAST(COALESCE(MAX(amount), 0) AS DOUBLE) AS high
  FROM props LEFT JOIN comp USING (elem_idx) GROUP BY elem""")
ORACLE["domain_means"] = f"WITH {RECORD}, {COMP}, {PROPS}, {PAIRS}, {PARAMS} SELECT domain, " + ", ".join(
    f"round(AVG(COALESCE(raw_params.{n}, 0)), 6) AS {n}" for n in ("delta", "tm", "entropy", "vec", "density")
) + " FROM record LEFT JOIN raw_params USING (row_id) GROUP BY domain"
add("sample_mappings", [RECORD, PHRASES, NOTED], """SELECT row_id, phrase, process_class FROM noted
  WHERE domain = 'corrosion' AND phrase IS NOT NULL AND phrase <> '0' ORDER BY row_id LIMIT 20""")

# --- scores ---------------------------------------------------------------------------

SCORED = """scored AS (SELECT l_orderkey % 5 AS fold,
  CASE l_returnflag WHEN 'A' THEN 'Hardness (HVN)' WHEN 'N' THEN 'Elongation (%)' ELSE 'icorr (log10)' END AS property,
  CAST(FLOOR(l_extendedprice) AS BIGINT) AS truth, CAST(l_quantity AS BIGINT) * 2000 AS guess FROM lineitem)"""
# whole numbers: 1 - n * SSres / (n * sum(y^2) - sum(y)^2)
_R2 = """1 - CAST(COUNT(*) * SUM((truth - guess) * (truth - guess)) AS DOUBLE)
  / CAST(COUNT(*) * SUM(truth * truth) - SUM(truth) * SUM(truth) AS DOUBLE)"""
FOLDS = f"""folds AS (SELECT 'A' AS model_family, property, fold, {_R2} AS r2, COUNT(*) AS n FROM scored GROUP BY property, fold
  UNION ALL SELECT 'B', property, fold, {_R2}, COUNT(*) FROM (SELECT property, fold, truth, guess + 5000 AS guess FROM scored)
  GROUP BY property, fold),
summary AS (SELECT property, model_family, AVG(r2) AS r2, stddev_pop(r2) AS std, CAST(SUM(n) AS BIGINT) AS n
  FROM folds GROUP BY property, model_family)"""
add("r2_by_fold", [SCORED], f"SELECT fold, round({_R2}, 9) AS r2, COUNT(*) AS n FROM scored GROUP BY fold")
add("accuracy", [RECORD], """SELECT domain, CAST(SUM(CASE WHEN fcc = bcc THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS accuracy,
  COUNT(*) AS n FROM record GROUP BY domain""")
add("cv_summary", [SCORED, FOLDS], "SELECT property, model_family, round(r2, 9) AS r2, round(std, 9) AS std, n FROM summary")
add("metrics_report", [SCORED, FOLDS], """SELECT split_part(property, ' (', 1) AS property, model_family, round(r2, 3) AS r2,
  round(std, 3) AS std, n FROM summary""")
add("model_compare", [SCORED, FOLDS], """SELECT property, round(MAX(CASE WHEN model_family = 'A' THEN r2 END), 9) AS r2_a,
  round(MAX(CASE WHEN model_family = 'B' THEN r2 END), 9) AS r2_b FROM summary GROUP BY property""")
add("results_union", [*_SHARED, VIOL], """SELECT row_id, 'A' AS model_family FROM viol WHERE """
    + " AND ".join(f"{n} <= 0" for n in _V) + """ UNION ALL SELECT row_id, 'B' FROM viol WHERE v_max_elements <= -1 AND """
    + " AND ".join(f"{n} <= 0" for n in _V if n not in ("v_max_elements", "v_required_Al")))

# --- text -----------------------------------------------------------------------------

add("process_class", [RECORD, PHRASES, NOTED], "SELECT row_id, phrase, process_class FROM noted")
_WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
ORACLE["process_class_documents"] = (
    "SELECT doc_id, CASE WHEN v IS NULL OR v IN ('0', '', 'missing', 'nan') THEN 1 "
    + " ".join(f"WHEN {_matches(cls)} THEN {cls}" for cls in (7, 6, 4, 5, 3, 2))
    + f" ELSE 1 END AS process_class FROM (SELECT doc_id, lower(trim(text, {_WHITE})) AS v FROM documents)"
)
ORACLE["process_rules_documents"] = ORACLE["process_class_documents"]
ORACLE["checked_scan"] = """SELECT o_orderkey, CASE WHEN reason IS NULL THEN o_custkey END AS o_custkey,
  CASE WHEN reason IS NULL AND o_orderkey % 83 <> 0 THEN o_totalprice END AS o_totalprice, reason
  FROM (SELECT *, CASE WHEN o_orderkey % 101 = 0 THEN 'wrong number of fields' WHEN o_orderkey % 97 = 0 AND o_orderkey % 89 = 0
  THEN 'o_custkey: not a bigint; o_totalprice: not a double' WHEN o_orderkey % 97 = 0 THEN 'o_custkey: not a bigint'
  WHEN o_orderkey % 89 = 0 THEN 'o_totalprice: not a double' END AS reason FROM orders)"""
add("process_argmax", [CAND], f"""SELECT row_id, best, CASE best + 1 {_LABELS} ELSE 'Unknown' END AS process FROM
  (SELECT row_id, CAST(arg_max(elem_idx - 32, raw * 100 - elem_idx) AS INTEGER) AS best FROM cand WHERE elem_idx >= 32 GROUP BY row_id)""")
_PHASE_OF = "CASE elem_idx WHEN 32 THEN 'FCC' WHEN 33 THEN 'BCC' WHEN 34 THEN 'HCP' ELSE 'IM' END"
add("phase_label", [CAND], f"""SELECT row_id, COALESCE(string_agg({_PHASE_OF}, '+' ORDER BY elem_idx) FILTER (WHERE raw > 150000),
  arg_max({_PHASE_OF}, raw * 100 - elem_idx) || ' (dominant)') AS phase
  FROM cand WHERE elem_idx BETWEEN 32 AND 35 GROUP BY row_id""")

# --- screening ------------------------------------------------------------------------

ORACLE["candidates"] = "SELECT o_orderkey AS row_id, " + ", ".join(
    f"-3.0::DOUBLE + {hash_sql('o_orderkey', f'2:{i}')} / 4294967296.0::DOUBLE * 6.0::DOUBLE AS z{i}" for i in range(10)
) + " FROM orders"


def _layer(k: int, source: str) -> str:
    width = 9 if k == 0 else 38
    weight = f"((u * 7 + i * 3 + {k} * 2 + 3) % 5 - 2)"
    bias = f"((u * 7 - 3 + {k} * 2 + 3) % 5 - 2)"
    return f"""layer{k} AS (SELECT row_id, u, CAST(greatest(SUM(value * {weight}) + {bias}, 0) AS BIGINT) AS value
  FROM (SELECT row_id, {source} FROM {'cand' if k == 0 else f'layer{k - 1}'}{' WHERE elem_idx < 10' if k == 0 else ''}),
  range(0, 39) AS r(u) WHERE i <= {width} GROUP BY row_id, u)"""


add("dense_relu", [CAND, _layer(0, "elem_idx AS i, raw AS value"), _layer(1, "u AS i, value"), _layer(2, "u AS i, value")],
    "SELECT row_id, CAST(u AS INTEGER) AS unit, CAST(value AS DOUBLE) AS value FROM layer2")
add("decode_candidates", [CAND, COMP, f"""bounds AS (SELECT elem_idx, CASE WHEN COUNT(*) < (SELECT COUNT(DISTINCT row_id) FROM comp)
  THEN 0 ELSE MIN(amount) END AS low, MAX(amount) AS high FROM comp GROUP BY elem_idx)"""],
    "SELECT row_id, elem_idx, CAST(raw * high + low AS DOUBLE) AS amount FROM cand JOIN bounds USING (elem_idx)")
_OBJECTIVE_SQL = {"icorr_log10": "round(icorr_log10, 9)", "density": "COALESCE(density, 0)", "Al": 'COALESCE("Al", 0)'}
add("objective_matrix", [RECORD, PREPARED, COMP, PROPS, WIDE], """, dens AS (SELECT row_id, CAST(SUM(amount * mass) AS DOUBLE)
  / SUM(amount * volume) AS density FROM comp JOIN props USING (elem_idx) GROUP BY row_id)
  SELECT row_id, """ + ", ".join(
    f"{'0 - ' if way == 'maximize' else ''}CAST({_OBJECTIVE_SQL.get(col, col)} AS DOUBLE) AS f_{name.lower().replace(' ', '_')}"
    for name, (way, _, col) in K.OBJECTIVES.items()) + " FROM prepared LEFT JOIN dens USING (row_id) LEFT JOIN wide USING (row_id)")
POINTS = """points AS (SELECT p_partkey AS id, p_retailprice AS o1, CAST(-p_size AS BIGINT) AS o2,
  (p_partkey * 7919) % 1000 AS o3 FROM part)"""


def _undominated(source: str) -> str:
    return f"""SELECT * FROM {source} b WHERE NOT EXISTS (SELECT 1 FROM {source} a WHERE a.o1 <= b.o1 AND a.o2 <= b.o2
  AND a.o3 <= b.o3 AND (a.o1 < b.o1 OR a.o2 < b.o2 OR a.o3 < b.o3))"""


# A rank is the length of the longest chain of points that dominate one another and end in the row.
RANKS = """dominates AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON a.o1 <= b.o1 AND a.o2 <= b.o2
  AND a.o3 <= b.o3 AND (a.o1 < b.o1 OR a.o2 < b.o2 OR a.o3 < b.o3)),
chains(id, n) AS (SELECT id, 1 FROM points UNION SELECT b, n + 1 FROM chains JOIN dominates ON a = id),
ranks AS (SELECT p.*, n AS pareto_rank FROM points p JOIN (SELECT id, CAST(max(n) AS INTEGER) AS n FROM chains GROUP BY id) USING (id))"""
add("pareto_front", [POINTS], _undominated("points"))
add("pareto_rank", [POINTS, RANKS], "SELECT id, o1, o2, o3, pareto_rank FROM ranks")


def _gap(o: str) -> str:
    over = f"OVER (PARTITION BY pareto_rank ORDER BY {o}, id)"
    span = f"MAX({o}) OVER (PARTITION BY pareto_rank) - MIN({o}) OVER (PARTITION BY pareto_rank)"
    return f"""CASE WHEN pareto_rank IS NULL OR lead({o}) {over} IS NULL OR lag({o}) {over} IS NULL THEN NULL WHEN {span} = 0 THEN 0
  ELSE CAST(lead({o}) {over} - lag({o}) {over} AS DOUBLE) / CAST({span} AS DOUBLE) END"""


add("crowding_distance", [POINTS, RANKS], f"""SELECT id, pareto_rank, round((g1 + g2 + g3) / 3, 9) AS crowding FROM
  (SELECT id, pareto_rank, {_gap('o1')} AS g1, {_gap('o2')} AS g2, {_gap('o3')} AS g3 FROM ranks)""")
add("front_pairs", [RECORD, PREPARED], " UNION ALL ".join(
    f"SELECT row_id, '{title}' AS title, '{x}' AS x_name, '{y}' AS y_name, CAST({K.OBJECTIVES[x][2]} AS DOUBLE) AS x, "
    f"CAST({K.OBJECTIVES[y][2]} AS DOUBLE) AS y FROM prepared"
    for x, y, title in [
        ("Hardness", "Yield Strength", "Mechanical"), ("Hardness", "Ecorr", "Mech vs Corrosion"),
        ("Ecorr", "Epit", "Corrosion"), ("Hardness", "FCC", "Hardness vs FCC"),
    ]))

# --- models ---------------------------------------------------------------------------
# What must hold for every row, whatever the forests answer.

_SEVEN = " UNION ALL ".join(f"SELECT row_id, '{t}' AS target, CAST({{}} AS DOUBLE) AS truth FROM prepared".format(
    f"round({t}, 9)" if t == "icorr_log10" else t) for t in K.TARGETS)
_MEDIA_LIST = ", ".join(f"'{m}'" for m in K.ELECTROLYTES)
_OWN_ROWS = {t: f"domain = 'mechanical' AND {t} IS NOT NULL" if t in K.MECH_TARGETS else
             f"domain = 'corrosion' AND electrolyte IN ({_MEDIA_LIST}) AND {t} IS NOT NULL" for t in K.TARGETS}
add("rf_regress", [RECORD, PREPARED], f"SELECT *, TRUE AS in_range, TRUE AS learned FROM ({_SEVEN})")
add("rf_classify", [RECORD], " UNION ALL ".join(
    f"SELECT '{p}' AS phase, COUNT(*) AS n, TRUE AS better_than_chance FROM record WHERE {p} IS NOT NULL "
    f"AND {hash_sql('row_id', '14')} < {int(0.1 * 4294967296)}" for p in K.PHASE_FLAGS))
add("cv_r2", [RECORD, PREPARED], " UNION ALL ".join(
    f"SELECT '{K.TARGET_LABELS[t]}' AS property, COUNT(*) AS n, TRUE AS scored FROM prepared WHERE {_OWN_ROWS[t]}" for t in K.TARGETS))
add("chained_impute", [RECORD, PREPARED], "SELECT row_id, " + ", ".join(
    f"round({t}, 9) AS {t}" if t == "icorr_log10" else t for t in K.TARGETS) + ", 0 AS n_gaps FROM prepared")
add("nested_cv_r2", [RECORD, PREPARED], " UNION ALL ".join(
    f"SELECT '{t}' AS target, COUNT(*) AS n, TRUE AS scored FROM prepared WHERE {t} IS NOT NULL AND domain = "
    f"'{'mechanical' if t in K.MECH_TARGETS else 'corrosion'}'" for t in K.TARGETS))
add("batch_score", [RECORD], f"SELECT row_id, {len(K.TARGETS)} AS n_in_range, {len(K.TARGETS)} AS n_learned FROM record")
add("phase_probability", [RECORD], f"SELECT row_id, {len(K.PHASE_FLAGS)} AS n_probabilities FROM record")
add("two_stage_score", [RECORD], f"SELECT row_id, {2 * len(K.PHASE_FLAGS)} AS n_flags, {len(K.TARGETS)} AS n_in_range FROM record")
add("screen_report", [CAND, COMP, PROPS, f"""bounds AS (SELECT elem_idx, CASE WHEN COUNT(*) < (SELECT COUNT(DISTINCT row_id) FROM comp)
  THEN 0 ELSE MIN(amount) END AS low, MAX(amount) AS high FROM comp GROUP BY elem_idx)""",
  "amounts AS (SELECT row_id, elem_idx, CAST(raw * high + low AS DOUBLE) AS a FROM cand JOIN bounds USING (elem_idx))",
  """facts AS (SELECT row_id, SUM(a) AS w, MAX(a) AS top, SUM(a * mass) / SUM(a * volume) AS density,
  -SUM(CASE WHEN elem = 'Al' THEN a ELSE 0 END) AS al FROM amounts JOIN props USING (elem_idx) GROUP BY row_id)""",
  f"kept AS (SELECT * FROM facts WHERE w > 0 AND top / w <= {K.MAX_FRACTION})",
  """front AS (SELECT b.* FROM kept b WHERE NOT EXISTS (SELECT 1 FROM kept a WHERE a.density <= b.density AND a.al <= b.al
  AND (a.density < b.density OR a.al < b.al)))""",
  "best AS (SELECT row_id, CAST(arg_max(elem_idx - 32, raw * 100 - elem_idx) AS INTEGER) AS best FROM cand WHERE elem_idx >= 32 GROUP BY row_id)"],
  f"""SELECT row_id, CAST(SUM(CASE WHEN a > {K.PRESENT_ABOVE} * w THEN 1 ELSE 0 END) AS INTEGER) AS n_elements,
  CASE any_value(best) + 1 {_LABELS} ELSE 'Unknown' END AS process, 1.0::DOUBLE AS composition_sum, TRUE AS scored
  FROM front JOIN amounts USING (row_id) JOIN best USING (row_id) GROUP BY row_id""")
