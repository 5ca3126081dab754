"""Processing-note classifier, composition strings and labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meltframe import constants as K


def process_class(note: Column, rules: Sequence = tuple(K.PROCESSING_RULES)) -> Column:
    """Class 1..7 of a free-text processing note; the first rule with a keyword hit decides."""
    text = F.lower(F.trim(note, F.lit(" \t\n\r\f\v")))
    missing = note.isNull() | text.isin(K.MISSING_TOKENS)
    # A rule that gives the default class and has no rule for another class after it decides nothing.
    last = max(i for i, (cls, _) in enumerate(rules) if cls != K.DEFAULT_CLASS)
    out = F.when(missing, F.lit(K.DEFAULT_CLASS))
    for cls, keywords in rules[: last + 1]:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords]), F.lit(cls))
    return out.otherwise(F.lit(K.DEFAULT_CLASS))


def process_label(code: Column) -> Column:
    pairs = [F.lit(v) for kv in K.PROCESS_LABELS.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("Unknown"))


def first_max(scores: Column) -> Column:
    """0-based position of the largest entry; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def fraction_text(share: Column) -> Column:
    """Share with three decimals, half-even."""
    thousandths = F.bround(share * 1000).cast("int")
    return F.concat(
        F.floor(thousandths / 1000).cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0")
    )


def composition_string(present: Column) -> Column:
    """`Al0.330Cr0.330Fe0.340` from an array of (elem_idx, share), already in element order."""
    symbols = F.expr("array(" + ", ".join(f"'{e}'" for e in K.ELEMENTS) + ")")
    return F.array_join(
        F.transform(present, lambda t: F.concat(F.get(symbols, t["elem_idx"]), fraction_text(t["share"]))), ""
    )


def parse_composition(text: Column) -> Column:
    """Array of (elem, share) read back from a composition string."""
    pattern = F.lit(r"([A-Z][a-z]?)([0-9.]+)")
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, pattern, F.lit(1)).alias("elem"),
            F.regexp_extract_all(text, pattern, F.lit(2)).alias("share"),
        ),
        lambda t: F.struct(t["elem"].alias("elem"), t["share"].cast("double").alias("share")),
    )


def phase_label(flags: Sequence[Column], scores: Sequence[Column], names: Sequence[str] = tuple(K.PHASES)) -> Column:
    """Names of the phases present joined by `+`, else the best-scored one marked dominant."""
    present = F.concat_ws("+", *[F.when(f > 0, F.lit(n)) for f, n in zip(flags, names, strict=True)])
    best = F.get(F.array(*[F.lit(n) for n in names]), first_max(F.array(*scores)))
    return F.when(present != "", present).otherwise(F.concat(best, F.lit(" (dominant)")))


def short_name(label: Column) -> Column:
    """Part of a label before its unit."""
    return F.substring_index(label, " (", 1)
