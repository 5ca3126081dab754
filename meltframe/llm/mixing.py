"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Points of the golden-ratio sequence are mapped through the cumulative shares of the sources: point i belongs to the source in whose
interval it falls, so every stretch of the schedule holds the sources in nearly their shares. A source's slots are ranked in the order
of the points and cut at the number of blocks it needs. Its documents, shuffled by a hash, form one stream of words (twice over where
the target exceeds the source), which is cut into blocks of equal words; slot k takes block k. The last slot of a source takes only the
words that are left of its target, so each source ends at its target rounded down, and no document is taken more than twice.

Defined results: null texts and texts without words have size 0 and nothing is taken of them; a null source is a source, the last one;
repeated rows are documents of their own, and which of two identical rows is in part taken does not matter, as the result has both; an
empty table gives an empty table; other columns are ignored by `mix` and carried by `apply_mix`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meltframe.llm.common import word_count
from meltframe.session import stored

# floor(2^32 / golden ratio): consecutive multiples modulo 2^32 are the golden-ratio sequence.
GOLDEN = 2_654_435_769
SPAN = 4_294_967_296
# Cells of the table that leads a point to the intervals it can fall in.
CELLS = 4_096
# Rows that one window group may hold: documents of a shuffle bucket, points of a stretch of the schedule.
GROUP_ROWS = 20_000


@dataclass(frozen=True)
class MixPlan:
    weights: Sequence[float] = (5.0, 2.0, 1.0)  # of the sources by name, repeating
    share: float = 1.5  # of all words
    most: float = 2.0  # times a source's words; at most 2
    block_words: int = 1_024


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffle position `h` (32 bits of a hash of the id)."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h"))


def targets(measured: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per source: place (0 first), source_size, n_docs, target.

    The weights share `share` of all words. Where that is over `most` times a source, the source stops there and the others share the
    rest: with the sources in order of the ratio of stop to weight, those below the level are a prefix, so running sums find it.
    """
    per_source = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # one row per source: the only step here that sees all of them at once
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weights = F.array(*[F.lit(float(w)) for w in plan.weights])
    ranked = per_source.withColumn("place", (F.row_number().over(by_name) - 1).cast("int")).withColumn(
        "weight", F.get(weights, F.col("place") % len(plan.weights))).withColumn("stop", F.col("source_size") * F.lit(plan.most))
    before = Window.orderBy(F.col("stop") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(plan.share)
    level = (total - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    order = F.struct(F.col("stop") / F.col("weight"), F.col("place"))
    # the level is that of the first source which stays below its stop; rows with a null order do not count
    free = F.when(F.col("stop") / F.col("weight") > F.col("level"), order)
    found = ranked.withColumn("level", level).withColumn("water", F.min_by("level", free).over(everything))
    return found.select("source", "place", "source_size", "n_docs",
                        F.least("stop", F.coalesce(F.col("weight") * F.col("water"), F.col("stop"))).alias("target"))


def schedule(sources: DataFrame, plan: MixPlan) -> DataFrame:
    """slot (the point's number), place, block (the slot's rank in its source), words."""
    spark = sources.sparkSession
    wanted = sources.where("target >= 1").select(
        "place", F.floor("target").alias("words"), F.ceil(F.floor("target") / plan.block_words).cast("bigint").alias("slots"))
    every, upto = Window.partitionBy(), Window.orderBy("place")
    shares = wanted.withColumn("high", F.sum("slots").over(upto)).withColumn("all", F.sum("slots").over(every)).select(
        "place", "words", "slots", "all",
        F.floor((F.col("high") - F.col("slots")) / F.col("all") * SPAN).cast("bigint").alias("low"),
        F.floor(F.col("high") / F.col("all") * SPAN).cast("bigint").alias("high"))
    shares = stored(shares)
    n_slots = shares.agg(F.max("all")).first()[0] or 0
    # n points of the sequence leave no gap over 2.62 / n, so three times the slots give every source all it needs
    points = spark.range(3 * n_slots + 8).select(
        F.col("id").alias("slot"), ((F.col("id") % (SPAN // 2)) * F.lit(GOLDEN) % F.lit(SPAN)).alias("at"))
    step = SPAN // CELLS
    spans = shares.where("high > low").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))))
    placed = points.withColumn("cell", F.floor(F.col("at") / step)).join(spans, "cell").where("at >= low and at < high").select(
        "slot", "place", "slots", "words", F.floor(F.col("slot") / GROUP_ROWS).alias("stretch"))
    counts = placed.groupBy("place", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("place").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("place", "stretch").orderBy("slot")) - 1
    ranked = placed.withColumn("rank", rank).join(counts, ["place", "stretch"]).withColumn("block", F.col("ahead") + F.col("rank"))
    width = F.least(F.lit(plan.block_words).cast("bigint"), F.col("words") - F.col("block") * plan.block_words)
    return ranked.where("block < slots").select("slot", "place", "block", width.alias("words"))


def lay_out(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, place, size, source_size, target, at: the documents of each source shuffled, `at` the words of its source before it.

    The shuffle order is the hash's. Running sums are taken inside hash buckets of bounded size; the buckets' totals are summed apart.
    """
    known = measured.join(sources, measured["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "place", "size", "h", "source_size", "target",
        F.floor(F.col("h") * F.ceil(F.col("n_docs") / (GROUP_ROWS // 2)) / SPAN).cast("bigint").alias("bucket"))
    totals = known.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("place", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("place", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return known.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["place", "bucket"]).select(
        "doc_id", "place", "size", "source_size", "target", (F.col("ahead") + F.col("inside")).alias("at"))


def blocks_of(laid: DataFrame, plan: MixPlan) -> DataFrame:
    """A row per document and block it reaches into: place, at, doc_id, size, source_size, target, pass, block, start, stop (words of the stream).

    A document without words has one row with null block.
    """
    passes = F.when(F.col("size") == 0, F.array().cast("array<int>")).when(
        F.col("target") > F.col("source_size"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    runs = laid.withColumn("pass", F.explode_outer(passes)).withColumn(
        "start", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("stop", F.col("start") + F.col("size"))
    first, last = F.floor(F.col("start") / plan.block_words), F.floor((F.col("stop") - 1) / plan.block_words)
    return runs.withColumn("block", F.explode_outer(F.sequence(first, last)))


def mix(docs: DataFrame, plan: MixPlan | None = None) -> DataFrame:
    """One row per document: doc_id, place (of its source), size, source_size, target, taken, first_slot, copy_slots.

    `taken` are the words the slots take of it, `first_slot` the slot that takes the first of them in the order of the schedule (null if
    none does), `copy_slots` that of each pass in which any are taken.
    """
    plan = plan or MixPlan()
    if not 0 < plan.most <= 2:
        raise ValueError("a source is passed twice at most")
    measured = stored(measure(docs))
    sources = stored(targets(measured, plan))
    slots = schedule(sources, plan).withColumnRenamed("words", "width").select("place", "block", "width", "slot")
    pieces = blocks_of(lay_out(measured, sources), plan)
    joined = pieces.join(slots, ["place", "block"], "left")
    begin = F.col("block") * plan.block_words
    words = F.greatest(F.lit(0), F.least("stop", begin + F.col("width")) - F.greatest("start", begin))
    # least and greatest pass over nulls, so a block that no slot takes is told apart first
    per_pass = joined.withColumn("words", F.when(F.col("width").isNull(), F.lit(0)).otherwise(words))
    key = ["place", "at", "doc_id", "size", "source_size", "target"]
    taken = per_pass.groupBy(*key).agg(
        F.sum("words").cast("bigint").alias("taken"),
        *[F.min(F.when((F.col("words") > 0) & (F.col("pass") == p), F.col("slot"))).alias(f"slot{p}") for p in (0, 1)],
        F.count(F.when(F.col("block").isNull(), 1)).alias("empties"))
    # documents without words share a position with their neighbour: identical ones were counted together
    taken = taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("empties")))))
    return taken.select("doc_id", "place", "size", "source_size", "target", "taken", F.least("slot0", "slot1").alias("first_slot"),
                        F.array_compact(F.array("slot0", "slot1")).alias("copy_slots"))


def apply_mix(docs: DataFrame, plan: MixPlan | None = None) -> DataFrame:
    """The mixed documents with all their columns, in the order of the schedule's slots, each as often as the mix takes words of it.

    Documents stay whole: the one at the end of a source is there although the target falls inside it, so a source's words can exceed its
    target by less than that document's.
    """
    names = [f"{c}_{n}" for n in range(len(docs.columns) + 1) for c in ("mixed_id", "mixed_size", "mixed_slots", "row_size", "slot")]
    mixed_id, mixed_size, mixed_slots, row_size, slot = [c for c in names if c not in docs.columns][:5]
    # rows that repeat an id and a size are alike to the schedule: each gets what the one with most copies gets
    mixed = mix(docs, plan).where(F.size("copy_slots") > 0).groupBy(F.col("doc_id").alias(mixed_id), F.col("size").alias(mixed_size)).agg(
        F.max_by("copy_slots", F.struct(F.size("copy_slots"), "first_slot")).alias(mixed_slots))
    sized = docs.withColumn(row_size, word_count(F.col("text")))
    match = F.col("doc_id").eqNullSafe(F.col(mixed_id)) & (F.col(row_size) == F.col(mixed_size))
    out = sized.join(mixed, match).withColumn(slot, F.explode(mixed_slots))
    return out.orderBy(slot, "doc_id").select(*docs.columns)
