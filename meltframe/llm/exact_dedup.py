"""Exact dedup with an extendible-hash index on shared files, in DataFrame functions only.

Texts are equal when they are the same bytes after lower-casing A-Z; null counts as empty. The index maps the 64-bit hash of a text to
its entry. A directory of 2^g cells (the leading g bits) points to buckets; a bucket with more than `capacity` keys is split by one
more bit, which doubles the directory where the bucket was as deep as it, and again until it fits. Entries are distinct texts, not rows,
made by a grouping that combines copies before it shuffles them, so a text with any number of copies is one entry and cannot overfill a
bucket. Owner tasks hold ranges of buckets, so ranges of keys: they chain the entries that share a key.

Every row finds its entry through the index: the leading bits of its hash name a cell, the cell a bucket, and in the bucket the chain of
its key is compared with its digest and length. Rows that have copies are then held byte by byte against the text of the entry they
found. Entries with many rows are dealt over several tasks in both steps. Rows that differ (two texts with one hash, digest and length)
are grouped by the bytes themselves.

Defined results: of equal texts the row with the largest doc_id stays (a null doc_id is smaller than any other, and stays only where
all are null); repeated rows with the largest id all refer to it, and all are `kept`; an empty table gives an empty table; other columns
are ignored by `find_copies` and carried by `drop_copies`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meltframe.llm.common import ascii_lower, maybe_broadcast
from meltframe.session import stored

# Keys a bucket may hold before it is split.
CAPACITY = 65_536
# Bits of a key the directory can use.
DEEPEST = 60
# Rows of one entry that one task compares.
ROWS_PER_TASK = 2_000


def normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _cell(key: Column, depth: int) -> Column:
    """Leading `depth` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def read_entries(docs: DataFrame) -> DataFrame:
    """doc_id, key (64-bit hash), sha (hex SHA-256) and bytes of every row's normalised text."""
    text = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    return text.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"),
                       F.octet_length("norm").cast("bigint").alias("bytes"))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(cell, bucket, local_depth) of every cell in use, and the global depth; `keys` is stored and has one row per entry.

    The keys are counted once per cell of a directory 16 times as large as full buckets need; where a cell still holds too many, the
    directory is doubled four times more. Splitting then works on those counts: a cell's bucket is the first depth at which its prefix
    holds at most `capacity`. Only entries that share their first 60 bits stay together beyond that.
    """
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, keys.count() / capacity)))) + 4)
    while True:
        cells = stored(keys.groupBy(_cell(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n")))
        if depth == DEEPEST or cells.where(F.col("n") > capacity).isEmpty():
            break
        depth = min(DEEPEST, depth + 4)
    prefixes = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")).withColumn(
        "prefix", F.expr(f"shiftrightunsigned(cell, {depth} - local_depth)"))
    fill = prefixes.groupBy("local_depth", "prefix").agg(F.sum("n").alias("n"))
    fits = prefixes.select("cell", "local_depth", "prefix").join(fill, ["local_depth", "prefix"]).where(
        (F.col("n") <= capacity) | (F.col("local_depth") == depth))
    chosen = fits.groupBy("cell").agg(F.min("local_depth").alias("local_depth"))
    bucket = F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - local_depth), {depth} - local_depth)")
    return stored(chosen.select("cell", bucket.alias("bucket"), "local_depth")), depth


def _routed(keyed: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """Rows with the bucket their key's directory cell points to."""
    pointers = cells.select("cell", "bucket")
    return keyed.withColumn("cell", _cell(F.col("key"), depth)).join(maybe_broadcast(pointers, pointers.count()), "cell").drop("cell")


def build_index(groups: DataFrame, cells: DataFrame, depth: int, capacity: int = CAPACITY) -> DataFrame:
    """The index: bucket, key, chain, sha, bytes, keep_id, group_size, parts, one row per distinct text, sorted by bucket and key.

    The table is written to shared files in ranges of buckets, so that a lookup of some keys reads few row groups. `parts` is the number
    of tasks that share the entry's rows.
    """
    owners = max(1, math.ceil(groups.count() / capacity))
    owned = _routed(groups, cells, depth).repartitionByRange(owners, "bucket", "key").sortWithinPartitions("bucket", "key", "sha")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha", "bytes")) - 1
    parts = F.ceil(F.col("group_size") / ROWS_PER_TASK).cast("int")
    return stored(owned.withColumn("chain", chain).withColumn("parts", parts))


def crowded_keys(index: DataFrame) -> DataFrame:
    """bucket, key, parts of the keys of entries whose rows several tasks share."""
    return stored(index.where("parts > 1").groupBy("bucket", "key").agg(F.max("parts").alias("parts")))


def _with_parts(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    return rows.join(maybe_broadcast(crowded, crowded.count()), ["bucket", "key"], "left")


def _dealt(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows with `part`, the task among those that share their key: 0 but for crowded keys."""
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0))
    return _with_parts(rows, crowded).withColumn("part", part).drop("parts")


def _spread(index: DataFrame, crowded: DataFrame) -> DataFrame:
    """Entries once for each part of their key."""
    parts = _with_parts(index.drop("parts"), crowded)
    return parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def lookup(entries: DataFrame, index: DataFrame, cells: DataFrame, depth: int, crowded: DataFrame) -> DataFrame:
    """doc_id, sha, bucket, key, chain, keep_id, group_size of every row, found by cell, bucket and a walk along the chain."""
    rows = _dealt(_routed(entries, cells, depth), crowded).withColumnsRenamed({"sha": "row_sha", "bytes": "row_bytes"})
    same = (F.col("row_sha") == F.col("sha")) & (F.col("row_bytes") == F.col("bytes"))
    return rows.join(_spread(index, crowded), ["bucket", "key", "part"]).where(same).select(
        "doc_id", "sha", "bucket", "key", "chain", "keep_id", "group_size")


def _compare(docs: DataFrame, index: DataFrame, cells: DataFrame, depth: int, crowded: DataFrame) -> DataFrame:
    """Rows whose bytes differ from the text of their entry: key, sha."""
    copied = stored(index.where("group_size > 1").select("bucket", "key", "sha", "keep_id", "chain"))
    keys = copied.select("key").distinct()
    rows = docs.select("doc_id", normal(F.col("text")).alias("norm")).withColumn("key", F.xxhash64("norm"))
    # only rows that have copies pass
    rows = rows.join(maybe_broadcast(keys, copied.count()), "key", "left_semi").withColumn("sha", F.sha2("norm", 256))
    rows = _dealt(_routed(rows, cells, depth), crowded)
    rows = stored(rows.join(maybe_broadcast(copied.withColumnRenamed("sha", "entry_sha"), copied.count()), ["bucket", "key"]).where(
        F.col("sha") == F.col("entry_sha")).select("doc_id", "bucket", "key", "chain", "part", "sha", "norm", "keep_id"))
    shown = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("bucket", "key", "chain").agg(F.min("norm").alias("entry_norm"))
    shown = shown.join(_spread(index.where("group_size > 1"), crowded).select("bucket", "key", "chain", "part"), ["bucket", "key", "chain"])
    differ = rows.join(shown, ["bucket", "key", "chain", "part"]).where(F.col("norm") != F.col("entry_norm"))
    return differ.select("key", "sha").distinct()


def find_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    entries = stored(read_entries(docs))
    groups = stored(entries.groupBy("key", "sha", "bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    cells, depth = directory(groups, capacity)
    index = build_index(groups, cells, depth, capacity)
    crowded = crowded_keys(index)
    found = lookup(entries, index, cells, depth, crowded)
    shared = stored(_compare(docs, index, cells, depth, crowded))
    if not shared.isEmpty():
        # texts that share key and digest with other bytes: those entries are grouped by the bytes themselves
        found = found.join(shared, ["key", "sha"], "left_anti")
        apart = docs.select("doc_id", normal(F.col("text")).alias("norm")).select(
            "doc_id", "norm", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha")).join(shared, ["key", "sha"])
        by_bytes = apart.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.select("doc_id", "keep_id", "group_size", "sha").unionByName(
            apart.join(by_bytes, "norm").select("doc_id", "keep_id", "group_size", "sha"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of repeated rows with one id one stays."""
    names = [f"{c}_{n}" for n in range(len(docs.columns) + 1) for c in ("found_id", "found_sha", "row_sha")]
    found_id, found_sha, row_sha = [c for c in names if c not in docs.columns][:3]
    found = stored(find_copies(docs, capacity).select(F.col("doc_id").alias(found_id), F.col("text_sha256").alias(found_sha), "kept"))
    gone = stored(found.where("not kept").distinct().drop("kept"))
    keyed = docs.withColumn(row_sha, F.sha2(normal(F.col("text")), 256))
    match = F.col("doc_id").eqNullSafe(F.col(found_id)) & (F.col(row_sha) == F.col(found_sha))
    stay = keyed.join(maybe_broadcast(gone, gone.count()), match, "left_anti")
    if not found.where("kept").groupBy(found_id, found_sha).count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", row_sha])
    return stay.drop(row_sha)
