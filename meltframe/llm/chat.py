"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template is data: how each role's turn opens and closes, whether its text carries loss, and which role may follow which.
Formatting gives one string per conversation and the list of its segments with a loss flag each; reading takes the string and the
segments apart again. Texts may hold anything: a control string inside a text is replaced by an escape before the turns are joined.

Defined results: a null role or text counts as empty; a role the template does not name is written out between the markers for
other roles; turns with equal numbers are ordered by role and then text, repeated rows are repeated turns, and null turn numbers come
first; rows with a null conversation id are one conversation; an empty table gives an empty table; other columns of the input are
ignored. A conversation that breaks the turn order is formatted all the same and marked: `valid` is false and `bad_turn` is the first
turn (from 0) at which the machine has no transition, or the number of turns if it ends in a state that is not final.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"
ESCAPE = "\\"


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """`roles` by name, the markers around the name of any other role, and the transitions of the machine."""

    turn_open: str = "<s>"
    turn_close: str = "</s>"
    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("[SYS]", "[/SYS]"),
        "user": Role("[INST]", "[/INST]"),
        "assistant": Role("[OUT]", "[/OUT]", loss=True),
    })
    other_open: str = "[ROLE]"
    other_close: str = "[/ROLE]"
    transitions: tuple[tuple[str, str], ...] = (
        (START, "system"), (START, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"),
    )
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """Every control string, in the order of its escape number."""
        marks = [self.turn_open, self.turn_close, self.other_open, self.other_close]
        for role in self.roles.values():
            marks += [role.open, role.close]
        if len(set(marks)) != len(marks) or any(not m or ESCAPE in m for m in marks):
            raise ValueError("control strings must be different, not empty and free of the escape character")
        return marks


def _code(number: int) -> str:
    """Escape of control string `number`; letters, so that no code is the start of another."""
    return ESCAPE + chr(ord("a") + number)


def escape(text: Column, template: Template) -> Column:
    """Backslash and control strings as two-character codes: no control string is left in the result."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for number, mark in enumerate(template.controls()):
        out = F.replace(out, F.lit(mark), F.lit(_code(number)))
    return out


def unescape(text: Column, template: Template) -> Column:
    """Inverse of `escape`. Every backslash of an escaped text starts a code, so the order of replacement is free but for the last."""
    out = text
    for number, mark in enumerate(template.controls()):
        out = F.replace(out, F.lit(_code(number)), F.lit(mark))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _segments(turn: Column, template: Template) -> Column:
    """The three segments of a turn: what opens it, its escaped text, what closes it."""
    def segment(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def segments(before: Column, loss: bool, after: Column) -> Column:
        return F.array(segment(before, False), segment(escape(turn["text"], template), loss), segment(after, False))

    name = F.concat(F.lit(template.turn_open + template.other_open), escape(turn["role"], template), F.lit(template.other_close))
    out = segments(name, False, F.lit(template.turn_close))
    for role, marks in template.roles.items():
        known = segments(F.lit(template.turn_open + marks.open), marks.loss, F.lit(marks.close + template.turn_close))
        out = F.when(turn["role"] == role, known).otherwise(out)
    return out


def _run_machine(turns: Column, template: Template) -> Column:
    """One step per turn: the state the machine is in, whether it has a transition for the turn's role, and the segments it emits.

    After a turn the machine is in the state named by its role, so every step knows its state from the turn before it, and a
    conversation of any length is one linear pass. From the first turn without a transition on it only emits.
    """
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in template.transitions])

    def step(turn: Column, at: Column) -> Column:
        state = F.when(at == 0, F.lit(START)).otherwise(F.get(turns, at - 1)["role"])
        return F.struct(
            state.alias("state"), F.array_contains(allowed, F.concat(state, F.lit(">"), turn["role"])).alias("goes"),
            _segments(turn, template).alias("segments"))

    return F.transform(turns, step)


def format_chat(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, text, segments (text, loss), n_turns, valid, bad_turn.

    The rows of a conversation meet in one task, since its text is one value; everything else is per row.
    """
    template = template or Template()
    empty = F.lit("")
    row = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    machine = grouped.select(
        "conv_id", F.size("turns").alias("n_turns"), F.element_at("turns", -1)["role"].alias("end"), _run_machine(F.col("turns"), template).alias("steps"))
    emitted = machine.select(
        "conv_id", "n_turns", "end", F.flatten(F.transform("steps", lambda s: s["segments"])).alias("segments"),
        (F.array_position(F.transform("steps", lambda s: s["goes"]), F.lit(False)) - 1).cast("int").alias("stuck"))
    bad = F.when(F.col("stuck") >= 0, F.col("stuck")).when(~F.col("end").isin(*template.final), F.col("n_turns"))
    return emitted.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), "segments", "n_turns",
        bad.isNull().alias("valid"), bad.alias("bad_turn"),
    )


def read_chat(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turns (role, text) parsed from the formatted string, the unescaped text under the loss mask, and the machine's verdict."""
    template = template or Template()

    def between(piece: Column, before: str, after: str) -> Column:
        return F.substring(piece, F.lit(len(before) + 1), F.length(piece) - len(before) - len(after))

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    def parse(piece: Column) -> Column:
        before, after = template.turn_open + template.other_open, template.other_close
        name = F.substring_index(F.substring(piece, F.lit(len(before) + 1), F.length(piece)), after, 1)
        rest = F.length(name) + len(before) + len(after)
        out = turn(unescape(name, template), F.substring(piece, rest + 1, F.length(piece)))
        for role, marks in template.roles.items():
            opened = template.turn_open + marks.open
            out = F.when(F.startswith(piece, F.lit(opened)), turn(F.lit(role), between(piece, opened, marks.close))).otherwise(out)
        return out

    # every turn ends with turn_close, so the last part of the split is empty; the mark is quoted for the regex
    pieces = F.split("text", "\\Q" + template.turn_close + "\\E")
    spoken = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    return formatted.select(
        "conv_id", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse).alias("turns"),
        F.array_join(spoken, "").alias("loss_text"), F.length("text").cast("bigint").alias("formatted_chars"), "valid", "bad_turn",
    )
