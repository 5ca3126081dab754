"""The manifest against a plain recursive construction, with nulls, ties, repeated rows, one row, empty tables and clashing names."""

import hashlib
import random

from pyspark.sql import functions as F

from meltframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return h(*[framed(v) for v in (row[0], row[3], row[2], row[4], text)])


def tree(nodes):
    """Top of the tree and each leaf's siblings from the lowest level up: [(before, after), ...]."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_groups = [], []
        for start in range(0, len(nodes), 16):
            run = nodes[start:start + 16]
            for k in range(len(run)):
                for i in groups[start + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(*run))
            up_groups.append([i for g in groups[start:start + 16] for i in g])
        nodes, groups = up, up_groups
    return nodes[0], paths


def brute(rows, tampered):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, found = [], []
    for name in names:
        members = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        top, paths = tree([leaf_of(r, r[1]) for r in members])
        tops.append(top)
        found.append((members, top, paths))
    root, upper = tree(tops)
    out = []
    for (members, top, paths), above in zip(found, upper):
        for row, path in zip(members, paths):
            node = leaf_of(row, tampered(row)) if tampered(row) is not None else leaf_of(row, row[1])
            for before, after in path + above:
                node = h(before, node, after)
            out.append((row[0], leaf_of(row, row[1]), top, root, h(*[b + a for b, a in path + above]), node, node == root))
    return sorted(out, key=repr)


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def check(spark, rows):
    def tampered(row):
        return lowered(row[1]) if row[0] is not None and row[0] % 3 == 0 else None

    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "at", "width", "digest", "path")})
    got = merkle.digests(merkle.manifest(docs, altered=F.when(F.col("doc_id") % 3 == 0, text))).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, tampered)


def test_equals_recursive_construction(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Ab", "cd", "", None, "é漢" * 50]), rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", "", None, "é"]),
             rng.choice([0, 7, None])) for i in range(700)]
    rows += [(9_000 + i, "T", "en", f"single{i}", 1) for i in range(20)]
    rows += [rows[3], rows[3], (4, "other", "en", rows[4][3], 1), (None, "N", None, "a", None), (None, None, None, None, None)]
    check(spark, rows)


def test_one_row_one_source_and_exact_powers(spark):
    check(spark, [(1, "One", "en", "s", 3)])
    check(spark, [(i, "t", "en", "s", 1) for i in range(16)])
    check(spark, [(i, "t", "en", "s", 1) for i in range(257)])


def test_empty_table(spark):
    found = merkle.digests(merkle.manifest(spark.createDataFrame([], SCHEMA)))
    assert found.collect() == [] and found.columns[:4] == ["doc_id", "leaf", "subroot", "root"]


def test_every_change_is_seen(spark):
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.digests(merkle.manifest(docs, altered=F.when(F.col("doc_id") < 10, F.lit("changed")))).collect()
    assert {r.doc_id for r in got if not r.verified} == set(range(10))
