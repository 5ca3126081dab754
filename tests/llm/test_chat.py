import hashlib

from meltframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, valid string, segments int"


def formatted(spark, rows):
    # two columns of the input have names the operator gives out itself
    return chat.format_chat(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))


def test_round_trip_of_control_strings_nulls_and_unknown_roles(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\0 \\a \\\\", "[/ROLE]", "<s></s>", None, "", "line\nfeed", "<</s>s>", "ü</s>\U0001F600"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(zip(["user", "assistant", None, "tool</s>", "[INST]"] * 2, nasty))]
    out = formatted(spark, rows)
    back = chat.read_chat(out).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(r or "", t or "") for _, _, r, t in rows]
    row = out.first()
    assert back["loss_text"] == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert row["text"] == "".join(s["text"] for s in row["segments"]) and back["formatted_chars"] == len(row["text"])
    assert row["text"].count("</s>") == len(rows)


def test_machine_marks_the_first_bad_turn(spark):
    cases = {
        1: (["user", "assistant"], None), 2: (["system", "user", "assistant", "user", "assistant"], None), 3: (["assistant"], 0),
        4: (["user", "user"], 1), 5: (["user"], 1), 6: (["system", "user", "assistant", "system"], 3), 7: (["user", "tool", "assistant"], 1),
    }
    rows = [(c, i, role, "t") for c, (roles, _) in cases.items() for i, role in enumerate(roles)]
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in formatted(spark, rows).collect()}
    assert got == {c: (bad is None, bad) for c, (_, bad) in cases.items()}


def test_order_of_ties_repeated_rows_null_ids_and_long_texts(spark):
    long = "wort " * 100_000
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "system", "s"), (5, 0, "user", "q"), (5, 0, "user", "q"), (6, 0, "assistant", long)]
    back = {r["conv_id"]: r for r in chat.read_chat(formatted(spark, rows)).collect()}
    assert [t["text"] for t in back[None]["turns"]] == ["s", "a", "b"]
    assert [t["text"] for t in back[5]["turns"]] == ["q", "q"]
    assert hashlib.sha256(back[6]["loss_text"].encode()).digest() == hashlib.sha256(long.encode()).digest()


def test_empty_table(spark):
    assert formatted(spark, []).count() == 0
    assert chat.read_chat(formatted(spark, [])).count() == 0


def test_templates_are_checked():
    import pytest

    with pytest.raises(ValueError):
        chat.Template(turn_open="a\\b").controls()
    with pytest.raises(ValueError):
        chat.Template(turn_open="</s>").controls()


def test_a_removed_transition_changes_the_verdict(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def verdicts(template):
        return {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in chat.read_chat(chat.format_chat(turns, template), template).collect()}

    assert verdicts(chat.Template()) == {1: (True, None), 2: (True, None)}
    fewer = tuple(t for t in chat.Template().transitions if t != ("assistant", "user"))
    assert verdicts(chat.Template(transitions=fewer)) == {1: (False, 2), 2: (True, None)}
    assert verdicts(chat.Template(final=("user",))) == {1: (False, 4), 2: (False, 2)}
