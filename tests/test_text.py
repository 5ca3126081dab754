import pytest
from pyspark.sql import functions as F

from meltframe import constants as K
from meltframe.functions import text as T
from meltframe.operators import composition as comp
from meltframe.operators import rules, screen
from meltframe.plans.views import phrases


def classes(spark, notes):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, note string")
    return [r["c"] for r in df.select("i", T.process_class(F.col("note")).alias("c")).orderBy("i").collect()]


def test_every_phrase_gets_its_class(spark):
    rows = phrases(spark).withColumn("got", T.process_class(F.col("phrase"))).collect()
    assert len(rows) == 24
    assert [(r["phrase"], r["got"]) for r in rows if r["got"] != r["expected_class"]] == []


def test_every_keyword_reaches_its_rule(spark):
    expected, notes = [], []
    for at, (_, keywords) in enumerate(K.PROCESSING_RULES):
        for k in keywords:
            note = f"xx {k.upper()} 9"
            first = next(cls for cls, ks in K.PROCESSING_RULES[: at + 1] if any(w in note.lower() for w in ks))
            notes.append(note)
            expected.append(first)
    assert classes(spark, notes) == expected


def test_missing_notes_and_blanks(spark):
    assert classes(spark, [None, " 0 ", "\t\n", "NaN", "Missing", "x", " 0 cryo"]) == [1, 1, 1, 1, 1, 1, 7]


def test_composition_string_round_trip(spark):
    rows = [(1, K.ELEMENT_INDEX["Al"], 1.0), (1, K.ELEMENT_INDEX["Cr"], 1.0), (1, K.ELEMENT_INDEX["Fe"], 1.0),
            (1, K.ELEMENT_INDEX["C"], 0.001), (2, K.ELEMENT_INDEX["W"], 3.0)]
    wide = comp.to_wide(spark.createDataFrame(rows, "row_id int, elem_idx int, amount double"))
    text = comp.with_total(wide).select("row_id", T.composition_string(comp.present_shares()).alias("composition"))
    assert {r["row_id"]: r["composition"] for r in text.collect()} == {1: "Al0.333Cr0.333Fe0.333", 2: "W1.000"}
    parsed = text.select("row_id", F.inline(T.parse_composition(F.col("composition")))).collect()
    assert {(r["row_id"], r["elem"]): r["share"] for r in parsed} == pytest.approx(
        {(1, "Al"): 0.333, (1, "Cr"): 0.333, (1, "Fe"): 0.333, (2, "W"): 1.0})


def test_banned_carbon_does_not_see_cobalt(spark):
    df = spark.createDataFrame([("Co0.500Cr0.500",), ("C0.100Fe0.900",), ("C0.005Fe0.995",), (None,)],
                               "composition string")
    kept = {r["composition"] for r in screen.banned_string_filter(df, ["C"]).collect()}
    assert kept == {"Co0.500Cr0.500", "C0.005Fe0.995", None}


def test_labels(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, [0.1, 0.9, 0.2, 0.3]), (0, 0, 0, 0, [0.4, 0.9, 0.9, 0.3])],
                               "a int, b int, c int, d int, s array<double>")
    flags = [F.col(c) for c in "abcd"]
    got = df.select(T.phase_label(flags, [F.get("s", F.lit(i)) for i in range(4)]).alias("p"),
                    T.first_max(F.col("s")).alias("m")).collect()
    assert [r["p"] for r in got] == ["FCC+IM", "BCC (dominant)"]
    assert [r["m"] for r in got] == [1, 1]
    codes = spark.createDataFrame([(7,), (9,), (None,)], "c int").select(T.process_label(F.col("c")).alias("l"))
    assert [r["l"] for r in codes.collect()] == ["Cryogenic treatments", "Unknown", "Unknown"]
    name = spark.range(1).select(T.short_name(F.lit("Hardness (HVN)")).alias("n")).first()["n"]
    assert name == "Hardness"


def test_rules_as_a_table_agree_with_the_columns(spark):
    notes = ["As-cast", "rolled and annealed at 900 °C", "", None, "nan", " CRYO rolled", "Laser cladding", "artificial aging", "plain", "x" * 5000 + "sinter"]
    df = spark.createDataFrame(list(enumerate(notes)), "id int, note string").withColumn("want", T.process_class(F.col("note")))
    out = rules.classify(df, F.col("note"), rules.rule_table(spark), "got")
    assert out.columns == ["id", "note", "want", "got"] and [r["got"] for r in out.collect()] == [r["want"] for r in out.collect()]
    assert rules.classify(df.limit(0), F.col("note"), rules.rule_table(spark)).count() == 0


def test_rule_table_ties_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "none"), (4, None)], "id int, note string")

    def run(rows, **options):
        table = spark.createDataFrame(rows, "priority long, class int, keyword string")
        return [r["class"] for r in rules.classify(df, F.col("note"), table, default=9, **options).orderBy("id").collect()]

    assert run([]) == [9, 9, 9, 9]
    assert run([(5, 2, "beta"), (1, 4, "alpha"), (7, 1, "beta"), (0, 3, None)]) == [4, 2, 9, 9]
    assert run([(1, 6, "alpha"), (1, 5, "beta")]) == [5, 5, 9, 9]
    assert run([(2, 6, ""), (1, 5, "alpha"), (3, 4, "beta")]) == [5, 6, 6, 9]
    with pytest.raises(ValueError, match="letters"):
        run([(1, 1, "a long keyword")], limit=5)
    with pytest.raises(ValueError, match="already"):
        rules.classify(df, F.col("note"), rules.rule_table(spark), "note")
