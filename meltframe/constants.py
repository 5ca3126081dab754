"""Element properties, pair enthalpies, rules, labels and names."""

from __future__ import annotations

# --- fixed values: element properties --------------------------------------
# columns: symbol, radius (Å), Tm (K), electronegativity, VEC, molar mass (g/mol),
# molar volume (cm³/mol), lattice parameter (Å), bulk modulus (GPa)
_ELEMENT_TABLE = """
Ag 1.44 1235 1.93 11 107.87 10.27 4.09 100
Al 1.43 933 1.61 3 26.98 10.00 4.05 76
B 0.87 2349 2.04 3 10.81 4.39 5.06 320
C 0.77 3823 2.55 4 12.01 5.29 3.57 443
Ca 1.97 1115 1.00 2 40.08 26.20 5.58 17
Co 1.25 1768 1.88 9 58.93 6.67 2.51 180
Cr 1.28 2180 1.66 6 52.00 7.23 2.88 160
Cu 1.28 1358 1.90 11 63.55 7.11 3.62 140
Fe 1.26 1811 1.83 8 55.85 7.09 2.87 170
Ga 1.22 303 1.81 3 69.72 11.80 4.52 59
Ge 1.22 1211 2.01 4 72.63 13.63 5.66 75
Hf 1.59 2506 1.30 4 178.49 13.44 3.20 110
Li 1.52 454 0.98 1 6.94 13.02 3.51 11
Mg 1.60 923 1.31 2 24.31 14.00 3.21 45
Mn 1.26 1519 1.55 7 54.94 7.35 8.91 120
Mo 1.36 2896 2.16 6 95.96 9.38 3.15 230
N 0.75 63 3.04 5 14.01 13.54 4.04 0
Nb 1.43 2750 1.60 5 92.91 10.83 3.30 170
Nd 1.82 1297 1.14 4 144.24 20.59 3.66 32
Ni 1.24 1728 1.91 10 58.69 6.59 3.52 180
Pd 1.37 1828 2.20 10 106.42 8.56 3.89 180
Re 1.37 3459 1.90 7 186.21 8.86 2.76 370
Sc 1.62 1814 1.36 3 44.96 15.00 3.31 57
Si 1.18 1687 1.90 4 28.09 12.06 5.43 98
Sn 1.40 505 1.96 4 118.71 16.29 5.83 58
Ta 1.43 3290 1.50 5 180.95 10.85 3.31 200
Ti 1.47 1941 1.54 4 47.87 10.64 2.95 110
V 1.34 2183 1.63 5 50.94 8.32 3.02 160
W 1.37 3695 2.36 6 183.84 9.47 3.16 310
Y 1.80 1799 1.22 3 88.91 19.88 3.65 41
Zn 1.33 693 1.65 12 65.38 9.16 2.66 70
Zr 1.60 2128 1.33 4 91.22 14.02 3.23 94
"""

# --- fixed values: pair mixing enthalpies in kJ/mol; a pair not listed is 0 ----
_PAIR_TABLE = """
Al: Co -19, Cr -10, Cu -1, Fe -11, Hf -45, Mg -2, Mn -19, Mo -22, Nb -18, Ni -22, Si -19, Ta -19, Ti -30, V -16, W -16, Zr -44
Co: Cr -4, Cu 6, Fe 0, Mn 0, Mo -5, Nb -25, Ni 0, Ti -28, V -14, W -1, Zr -41
Cr: Cu 12, Fe -1, Mn 2, Mo 0, Nb -7, Ni -7, Si -37, Ta -7, Ti -7, V -2, W 0, Zr -12
Cu: Fe 13, Mn 4, Mo 19, Ni 4, Ti -9, Zr -23
Fe: Mn 0, Mo -2, Nb -16, Ni -2, Si -35, Ta -15, Ti -17, V -7, W -6, Zr -25
Mn: Mo 0, Ni -8, Ti -8, V -1
Mo: Nb -6, Ni -7, Si -38, Ta -5, Ti -4, V -5, W 0, Zr -6
Nb: Ni -30, Si -56, Ta 0, Ti -2, V -2, W -8, Zr 4
Ni: Si -40, Ta -24, Ti -35, V -18, W -3, Zr -49
Si: Ta -45, Ti -66, V -48, W -37, Zr -84
Ta: Ti -4, V -1, W -7
Ti: V -2, W -27, Zr 0
V: W -8, Zr -4
W: Zr -27
"""

# --- fixed values: gas constant, presence threshold, single-element cap ---------
R_GAS = 8.314
PRESENT_ABOVE = 0.005
MAX_FRACTION = 0.60

# --- fixed values: processing-note keywords, in test order, first hit wins ------
MISSING_TOKENS = ["0", "", "missing", "nan"]
DEFAULT_CLASS = 1
PROCESSING_RULES = [
    (7, ["cryo"]),
    (6, ["roll", "forg", "wrough", "cold work", "hip", "vacuum hot", "vhps"]),
    (4, ["powder", "sinter", "ball mill", "milled for", "milling"]),
    (5, ["laser", "slm", "lpbf", "ebm", "sebm", "lmd", "plasma", "pvd", "spray", "cladding",
         "clad", "pta", "gta", "electroly", "electrochem", "passiv", "directional", "lsp"]),
    (3, ["anneal", "homo", "aging", "heat treat", "aged", "°c", "◦c", "re-melt",
         "remelted", "remelting", "equilibrat"]),
    (2, ["artificial aging", "age harden", "precipitation harden"]),
    (1, ["cast", "arc", "vacuum", "induction", "melt", "melted", "melting", "furnace",
         "copper mold", "suction", "as-", "solidif", "lm", "am", "amf", "ac"]),
]

# --- fixed values: display labels of the seven processing classes ---------------
PROCESS_LABELS = {
    1: "As-cast / arc-melted",
    2: "Arc-melted + artificial aging",
    3: "Arc-melted + annealing",
    4: "Powder metallurgy",
    5: "Additive / laser / plasma / novel synthesis",
    6: "Arc-melted + wrought processing",
    7: "Cryogenic treatments",
}

# --- fixed values: media, phases, parameter order -------------------------------
ELECTROLYTES = ["NaCl", "H2SO4", "Seawater", "HNO3", "NaOH", "HCl", "KOH"]
MAX_CONCENTRATION_M = 6.0
PHASES = ["FCC", "BCC", "HCP", "IM"]
EMPIRICAL = ["a", "delta", "tm", "tm_std", "entropy", "enthalpy", "enthalpy_spread", "omega",
             "chi", "chi_std", "vec", "vec_std", "bulk", "bulk_std", "density"]
# digits each parameter is stored with
EMPIRICAL_DIGITS = {"tm": 4, "tm_std": 4, "bulk": 4, "bulk_std": 4}
DEFAULT_DIGITS = 6

# --- fixed values: targets, clip limits, export names and digits ----------------
MECH_TARGETS = ["hardness", "yield_mpa", "tensile_mpa", "elongation_pct"]
CORR_TARGETS = ["ecorr_mv", "epit_mv", "icorr_log10"]
RAW_TARGETS = MECH_TARGETS + ["ecorr_mv", "epit_mv", "icorr"]
TARGETS = MECH_TARGETS + CORR_TARGETS
TARGET_LABELS = {
    "hardness": "Hardness (HVN)",
    "yield_mpa": "Yield Strength (MPa)",
    "tensile_mpa": "Ultimate Tensile Strength (MPa)",
    "elongation_pct": "Elongation (%)",
    "ecorr_mv": "Corrosion potential (mV vs SCE)",
    "epit_mv": "Pitting potential (mV vs SCE)",
    "icorr": "Corrosion current density (microA/cm2)",
    "icorr_log10": "icorr (log10)",
}
CLIP_RULES = {
    "hardness": (0.0, 3000.0),
    "yield_mpa": (0.0, 5000.0),
    "tensile_mpa": (0.0, 5000.0),
    "elongation_pct": (0.0, 100.0),
    "ecorr_mv": (-2000.0, 3000.0),
    "epit_mv": (-2000.0, 3000.0),
    "icorr_log10": (-6.0, 6.0),
}
ICORR_CEILING = 1e6

# --- fixed values: objectives: name -> (direction, unit, result column) ---------
OBJECTIVES = {
    "Tensile Strength": ("maximize", "MPa", "tensile_mpa"),
    "Yield Strength": ("maximize", "MPa", "yield_mpa"),
    "Elongation": ("maximize", "%", "elongation_pct"),
    "Hardness": ("maximize", "HV", "hardness"),
    "Ecorr": ("maximize", "mV vs SCE", "ecorr_mv"),
    "Epit": ("maximize", "mV vs SCE", "epit_mv"),
    "icorr": ("minimize", "µA/cm²", "icorr_log10"),
    "Density": ("minimize", "g/cm³", "density"),
    "FCC": ("maximize", "probability", "fcc"),
    "BCC": ("maximize", "probability", "bcc"),
    "HCP": ("maximize", "probability", "hcp"),
    "IM": ("maximize", "probability", "im"),
    "Aluminum Content": ("maximize", "molar ratio", "Al"),
}
MECH_OBJECTIVES = ["Tensile Strength", "Yield Strength", "Elongation", "Hardness"]
CORR_OBJECTIVES = ["Ecorr", "Epit", "icorr"]

# --- fixed values: result columns hidden from the display table -----------------
HIDDEN_COLUMNS = ["N Elements", "FCC probability", "BCC probability", "HCP probability",
                  "IM probability", "Al molar fraction", "Composition sum"]


# --- derived lookups ------------------------------------------------------------
PROPERTIES = ["radius", "tm", "chi", "vec", "mass", "volume", "lattice", "bulk"]
# Two-decimal properties are held as whole hundredths: sums of whole amounts times whole
# property values stay exact, and each statistic divides once.
SCALE = {"radius": 100, "tm": 1, "chi": 100, "vec": 1, "mass": 100, "volume": 100,
         "lattice": 100, "bulk": 1}

_rows = [line.split() for line in _ELEMENT_TABLE.split("\n") if line]
ELEMENTS = [r[0] for r in _rows]
ELEMENT_INDEX = {e: i for i, e in enumerate(ELEMENTS)}
PROPERTY_VALUES = {p: [float(r[k + 1]) for r in _rows] for k, p in enumerate(PROPERTIES)}
SCALED = {p: [round(v * SCALE[p]) for v in PROPERTY_VALUES[p]] for p in PROPERTIES}
PAIRS = [
    (first, entry.split()[0], int(entry.split()[1]))
    for first, rest in (line.split(": ") for line in _PAIR_TABLE.split("\n") if line)
    for entry in rest.split(", ")
]
PROCESS_FLAGS = [f"process_{i}" for i in range(1, 8)]
PHASE_FLAGS = [p.lower() for p in PHASES]
ELECTROLYTE_FLAGS = [f"el_{e.lower()}" for e in ELECTROLYTES]
MECH_FEATURES = ELEMENTS + PROCESS_FLAGS + EMPIRICAL + PHASE_FLAGS
CORR_FEATURES = MECH_FEATURES + ELECTROLYTE_FLAGS + ["conc_norm"]
