"""Keyword rules held as a table: a text gets the class of the first rule of which it contains a keyword.

The column form (`functions.text.process_class`) tests keyword after keyword and suits a few dozen. Here all keywords form one
Aho-Corasick automaton, so a text is read once however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltframe import constants as K

# Letters of all keywords together that a task's automaton may hold.
RULE_CHARS = 5_000_000


def rule_table(spark: SparkSession, rules: Sequence = tuple(K.PROCESSING_RULES)) -> DataFrame:
    """(priority, class, keyword) of nested rules; the order of the rules is their priority."""
    rows = [(at, cls, word) for at, (cls, words) in enumerate(rules) for word in words]
    return spark.createDataFrame(rows, "priority long, class int, keyword string")


def _decisive(rules: DataFrame, limit: int) -> list[tuple[int, int, str]]:
    """Each keyword once with its first rule; refused beyond the limit, which bounds what is sent to every task."""
    named = rules.where(F.col("keyword").isNotNull() & F.col("priority").isNotNull())
    first = named.groupBy("keyword").agg(F.min(F.struct("priority", "class")).alias("rule"))
    chars = first.agg(F.sum(F.length("keyword") + 1)).first()[0] or 0
    if chars > limit:
        raise ValueError(f"the keywords have {chars} letters, more than the {limit} one automaton may hold")
    return [(r["priority"], r["class"], r["keyword"]) for r in first.select("rule.*", "keyword").collect()]


def classify(df: DataFrame, text: Column, rules: DataFrame, out: str = "class", default: int = K.DEFAULT_CLASS,
             missing: Sequence[str] = tuple(K.MISSING_TOKENS), limit: int = RULE_CHARS) -> DataFrame:
    """Add the class of a text by the rules; every other column and row stays.

    Texts are trimmed and lower-cased, keywords are taken as they stand. The least priority decides, of equal ones the
    least class. NULL, the missing tokens and texts without a hit get the default; an empty keyword hits every other text,
    a NULL keyword none. An empty rule table gives the default everywhere.
    """
    if out in df.columns:
        raise ValueError(f"the table has a column {out} already")
    found = sorted(_decisive(rules, limit), key=lambda r: (r[0], r[1]))
    while found and found[-1][1] == default:  # rules after which only the default can follow decide nothing
        found.pop()
    shipped = df.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("int")
    def first_rule(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        held, automaton = shipped.value, ahocorasick.Automaton()
        always = len(held)
        for rank, (_, _, word) in enumerate(held):
            if word:
                automaton.add_word(word, rank)
            else:
                always = rank
        automaton.make_automaton()
        classes = [cls for _, cls, _ in held] + [default]

        def decide(value: str | None) -> int:
            if value is None:
                return default
            hits = automaton.iter(value) if len(automaton) else ()
            return classes[min(always, min((rank for _, rank in hits), default=always))]

        for batch in batches:
            yield pd.Series([decide(v) for v in batch], dtype="Int32")

    note = F.lower(F.trim(text, F.lit(" \t\n\r\f\v")))
    return df.withColumn(out, first_rule(F.when(~note.isin(list(missing)), note)))
