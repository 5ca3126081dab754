import hashlib

from pyspark.sql import functions as F

from meltframe.llm import exact_dedup as E


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(lower(text), []).append(i)
    out = []
    for i, text in rows:
        ids = groups[lower(text)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Text"), (2, "tEXT"), (3, "text "), (4, None), (5, ""), (6, "ÄB"), (7, "äB"), (8, "ÄB"), (9, "x" * 300_000), (10, "X" * 300_000),
        (None, "text"), (11, "only"), (11, "only"), (12, "12"), (12, "zwölf"), (None, "lonely")] + [(100 + i, "copy") for i in range(50)]


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_groups_of_all_kinds(docs_of):
    docs = docs_of(ROWS)
    assert found(E.find_copies(docs)) == brute(ROWS)
    # small buckets: the directory doubles until each holds three keys
    assert found(E.find_copies(docs, capacity=3)) == brute(ROWS)


def test_hot_entries_are_dealt_over_tasks(docs_of, monkeypatch):
    monkeypatch.setattr(E, "ROWS_PER_TASK", 7)
    assert found(E.find_copies(docs_of(ROWS))) == brute(ROWS)


def test_colliding_keys_are_told_apart_by_bytes(docs_of, monkeypatch):
    # one hash for all texts: entries chain on the digest
    monkeypatch.setattr(E.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    assert found(E.find_copies(docs_of(ROWS))) == brute(ROWS)
    # and one digest for all: the bytes decide
    monkeypatch.setattr(E.F, "sha2", lambda c, n: F.lit("same"))
    got = [(r[0], r[1], r[2], r[3]) for r in found(E.find_copies(docs_of([r for r in ROWS if len(r[1] or "") == 4])))]
    assert got == [r[:4] for r in brute([r for r in ROWS if len(r[1] or "") == 4])]


def test_directory_splits_only_full_buckets(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    cells, depth = E.directory(keys, capacity=50)
    placed = keys.withColumn("cell", E._cell(F.col("key"), depth)).join(cells, "cell")
    fill = placed.groupBy("bucket", "local_depth").count().collect()
    assert sum(r["count"] for r in fill) == 1000 and max(r["count"] for r in fill) <= 50
    # the bucket's parent was too full
    parents = placed.groupBy(F.expr(f"shiftrightunsigned(cell, {depth} - local_depth + 1)"), "local_depth").count()
    assert parents.where("local_depth > 0").agg(F.min("count")).first()[0] >= 1
    assert len({r["bucket"] for r in fill}) == len(fill)


def test_directory_goes_on_while_a_bucket_is_full(spark):
    """Keys that agree in their first 40 bits are still told apart."""
    keys = spark.range(64).select((F.col("id") * (1 << 12) + 5).alias("key"))
    cells, depth = E.directory(keys, capacity=4)
    fill = keys.withColumn("cell", E._cell(F.col("key"), depth)).join(cells, "cell").groupBy("bucket").count().collect()
    assert depth >= 50 and max(r["count"] for r in fill) <= 4


def test_rows_are_found_through_cells_and_buckets(docs_of):
    """A row whose cell is gone from the directory finds nothing; one whose cell points elsewhere finds nothing either."""
    docs = docs_of([(i, f"text {i % 40}") for i in range(120)])
    entries = E.read_entries(docs)
    groups = entries.groupBy("key", "sha", "bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    cells, depth = E.directory(groups, capacity=4)
    index = E.build_index(groups, cells, depth, capacity=4)
    crowded = E.crowded_keys(index)
    assert E.lookup(entries, index, cells, depth, crowded).count() == 120
    gone = cells.orderBy("cell").first()["cell"]
    lost = entries.where(E._cell(F.col("key"), depth) == gone).count()
    assert lost > 0 and E.lookup(entries, index, cells.where(F.col("cell") != gone), depth, crowded).count() == 120 - lost
    astray = cells.withColumn("bucket", F.when(F.col("cell") == gone, F.lit(-1)).otherwise(F.col("bucket")))
    assert E.lookup(entries, index, astray, depth, crowded).count() == 120 - lost


def test_drop_copies_keeps_columns_and_clashing_names(docs_of):
    docs = docs_of(ROWS).withColumn("kept", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("sha", F.lit(2)).withColumn("sha_of_row", F.lit("x")).withColumn("found_id_0", F.lit(3))
    out = E.drop_copies(docs)
    assert out.columns == docs.columns
    stay = {(i, sha) for i, _, _, kept, sha in brute(ROWS) if kept}
    assert sorted((str(r["doc_id"]), lower(r["text"])) for r in out.collect()) == sorted(
        (str(i), lower(t)) for i, t in {(i, lower(t)) for i, t in ROWS} if (i, hashlib.sha256(lower(t).encode()).hexdigest()) in stay)
    assert found(E.find_copies(docs)) == brute(ROWS)


def test_empty_table(docs_of):
    assert E.find_copies(docs_of([])).count() == 0 and E.drop_copies(docs_of([])).count() == 0
