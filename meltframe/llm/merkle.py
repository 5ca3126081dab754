"""Merkle manifest of a dataset, by slot pivots: one tree of fan-out 16 per source, and one over the sources' roots.

A document's leaf is the SHA-256 of its columns, each with its length in front. Leaves of a source stand in order of doc_id; every 16
consecutive nodes become one node of the next level, until one is left, the source's subroot. Subroots, in order of the source, form the
last tree, whose top is the root.

A level is one grouping: conditional aggregates spread the children of a parent into 16 slot columns. Concatenating the slots and hashing
them gives the parent; leaving out a child's own slot gives its siblings, so a proof needs no join of nodes with nodes. The slots of the
lowest level also carry what belongs to a leaf (its id, its digest after tampering). Going down again, each run of slots is joined with
the one path of its parent, which is a sixteenth of the rows; no task sees a source or a level in whole. Places within a source come
from a range partitioning: counts per partition and source are summed, so a source of any size is spread over many tasks.

Defined results: a null column is `-` in the leaf; a null source is a source of its own and the first; rows with equal doc_ids are ordered
by leaf, null doc_ids come first; repeated rows are leaves of their own; a source with one document has that leaf as subroot, and with one
source the subroot is the root; an empty table gives an empty table; columns other than the five hashed ones are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meltframe.llm.common import maybe_broadcast
from meltframe.session import free, stored

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
RESULT = f"doc_id long, leaf string, subroot string, root string, path {PATH}, altered string"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def unframed(framed_value: Column) -> Column:
    return F.when(framed_value != "-", F.substring(framed_value, F.instr(framed_value, ":") + 1, F.length(framed_value)))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row; `text` stands in for its text."""
    return hashed(*[framed(text if text is not None and c == "text" else F.col(c)) for c in COLUMNS])


def ranked(rows: DataFrame, tree: str, order: Sequence[Column]) -> DataFrame:
    """The rows with `at`, the place in their tree from 0, and `width`, the tree's number of rows.

    Rows are ranged over all trees at once and numbered as they are written; the table of (partition, tree) pairs, one row more per tree
    than there are partitions at most, says where each partition's share of a tree begins. Equal rows are told apart by their input
    place, so that any number of them is spread too.
    """
    keys = [F.col(tree), *order, F.col("input_place")]
    numbered = rows.withColumn("input_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = stored(numbered.drop("input_place").withColumn("number", F.monotonically_increasing_id()))
    part = F.shiftright("number", 33)
    shares = numbered.groupBy(F.col(tree).alias("of"), part.alias("part")).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = stored(shares.select(
        "of", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("of")).alias("width")))
    joined = numbered.withColumn("part", part).join(
        maybe_broadcast(shares.withColumnRenamed("part", "part_of"), shares.count()), (F.col(tree) == F.col("of")) & (F.col("part") == F.col("part_of")))
    return joined.withColumn("at", F.col("number") + F.col("shift")).drop("of", "part", "part_of", "number", "shift")


def pivot(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """A row per parent: tree, at, width, and slots c0 ... c15 (digest and the carried columns) of nodes that are not alone on their level."""
    slot = F.col("at") % FANOUT
    cell = F.struct("digest", *carried)
    return nodes.where("width > 1").groupBy(
        "tree", F.shiftright("at", 4).alias("up"), F.ceil(F.col("width") / FANOUT).cast("bigint").alias("up_width"),
    ).agg(*[F.max(F.when(slot == i, cell)).alias(f"c{i}") for i in range(FANOUT)])


def _joined(slots: Sequence[int]) -> Column:
    """Digests of some slots one after another; slots without a child add nothing."""
    return F.concat_ws("", *[F.col(f"c{i}")["digest"] for i in slots])


def parents(runs: DataFrame) -> DataFrame:
    return runs.select("tree", F.col("up").alias("at"), F.col("up_width").alias("width"), F.sha2(_joined(range(FANOUT)), 256).alias("digest"))


def children(runs: DataFrame, paths: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """tree, at, digest, carried columns, subroot and path of every child: its siblings before and after it, then its parent's path."""
    members = F.array(*[
        F.when(F.col(f"c{i}").isNotNull(), F.struct(
            F.lit(i).alias("slot"), F.col(f"c{i}").alias("cell"), _joined(range(i)).alias("before"), _joined(range(i + 1, FANOUT)).alias("after")))
        for i in range(FANOUT)])
    above = paths.select(F.col("tree").alias("of"), F.col("at").alias("of_at"), "subroot", F.col("path").alias("upper"))
    joined = runs.join(above, (F.col("tree") == F.col("of")) & (F.col("up") == F.col("of_at")))
    rows = joined.select("tree", "up", "subroot", "upper", F.explode(F.filter(members, lambda m: m.isNotNull())).alias("m"))
    return rows.select(
        "tree", (F.col("up") * FANOUT + F.col("m.slot")).alias("at"), "m.cell.digest", *[f"m.cell.{c}" for c in carried], "subroot",
        F.concat(F.array(F.struct("m.before", "m.after")), "upper").alias("path"))


def levels(nodes: DataFrame, carried: Sequence[str] = ()) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored runs of every level from the lowest up, and for each level the nodes that are tops of their trees."""
    runs, tops = [], []
    widest = nodes.agg(F.max("width")).first()[0] or 0
    while widest:
        tops.append(nodes.where("width = 1"))
        if widest == 1:
            break
        runs.append(stored(pivot(nodes, () if runs else carried)))
        nodes = parents(runs[-1])
        widest = -(-widest // FANOUT)
    return runs, tops


def descend(runs: list[DataFrame], tops: list[DataFrame], top_paths: DataFrame | None, carried: Sequence[str] = ()) -> DataFrame:
    """Paths of the lowest nodes; `top_paths` has the path above the top of each tree (tree, subroot, path), or is None where the
    trees' tops have nothing above them."""
    paths = None
    for level in reversed(range(len(tops))):
        kept = carried if level == 0 else ()
        if top_paths is None:
            ends = tops[level].withColumn("subroot", F.lit(None).cast("string")).withColumn("path", F.array().cast(PATH))
        else:
            # one row per tree that ends on this level
            ends = tops[level].join(top_paths.withColumnRenamed("tree", "of"), F.col("tree") == F.col("of"))
        ends = ends.select("tree", "at", "digest", *kept, "subroot", "path")
        paths = ends if paths is None else ends.unionByName(children(runs[level], paths, kept))
        if level:
            paths = stored(paths)
    return paths


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path (siblings before and after, from the leaf's run up to the root), altered.

    `altered` is the text of a tampered row, or null where a row is as it was; the result's `altered` is the leaf such a row would have.
    """
    spark = docs.sparkSession
    changed = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf(altered))
    rows = docs.select("doc_id", framed(F.col("source")).alias("tree"), leaf().alias("digest"), changed.alias("altered"))
    # the frame of a source begins with its length, so trees are in any order here; only the places within each matter
    leaves = ranked(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    carried = ("doc_id", "altered")
    runs, tops = levels(leaves, carried)
    if not tops:
        return spark.createDataFrame([], RESULT)
    ends = None
    for table in tops:
        table = table.select("digest", F.col("tree").alias("member"), unframed(F.col("tree")).alias("source"), F.lit("").alias("tree"))
        ends = table if ends is None else ends.unionByName(table)
    subroots = ranked(ends, "tree", [F.col("source").asc_nulls_first()])
    upper_runs, upper_tops = levels(subroots, ("member",))
    root = upper_tops[-1].first()["digest"]
    source_paths = descend(upper_runs, upper_tops, None, ("member",))
    source_paths = stored(source_paths.select(F.col("member").alias("tree"), F.col("digest").alias("subroot"), "path"))
    free(*upper_runs)
    paths = descend(runs, tops, source_paths, carried)
    return paths.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", "altered")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, step: hashed(step["before"], node, step["after"]))


def digests(found: DataFrame) -> DataFrame:
    """The manifest with a digest for each proof, and what the proof gives for the tampered leaf where there is one."""
    proof = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    folded = found.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
