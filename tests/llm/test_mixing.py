import math

from pyspark.sql import functions as F

from meltframe.llm import mixing as M


def targets(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def rows():
    out = [(i, f"{'wort ' * (i % 7 * 13)}", "xx", ["a", "b", "c", None, "hot"][min(4, i % 9)], 0) for i in range(400)]
    out += [(1, "wort", "xx", "a", 0), (1, "wort", "xx", "a", 0), (None, None, "xx", "b", 0), (2, "\t \n", "xx", "a", 0), (9_000, "lang " * 50_000, "xx", "hot", 0)]
    return out


def check(docs, plan):
    got = M.mix(docs, plan).collect()
    data = docs.collect()
    assert len(got) == len(data)
    sizes = {}
    for r in data:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    want, place = targets(sizes), {}
    for i, s in enumerate(sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]):
        place[i] = s
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = place[r["place"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert taken[s] == math.floor(want[s] + 1e-9)


def test_every_source_ends_at_its_target(docs_of):
    docs = docs_of(rows()).withColumn("size", F.lit("mine")).withColumn("h", F.lit(1)).withColumn("taken", F.lit(0))
    check(docs, M.MixPlan(block_words=17))
    check(docs, M.MixPlan())


def test_small_groups_and_reruns_agree(docs_of, monkeypatch):
    monkeypatch.setattr(M, "GROUP_ROWS", 8)
    docs = docs_of(rows())
    check(docs, M.MixPlan(block_words=50))
    first, second = [sorted(map(tuple, M.mix(d, M.MixPlan(block_words=50)).collect()), key=str) for d in (docs, docs.repartition(5))]
    assert first == second


def test_schedule_is_even_in_every_stretch(docs_of, spark):
    docs = docs_of([(i, "w " * 100, "xx", "abc"[i % 3], 0) for i in range(300)])
    plan = M.MixPlan(block_words=10)
    sources = M.targets(M.measure(docs), plan)
    slots = M.schedule(sources, plan).orderBy("slot").collect()
    share = {r["place"]: r["target"] for r in sources.collect()}
    total = sum(share.values())
    seen = dict.fromkeys(share, 0)
    for n, r in enumerate(slots[:2000], 1):
        seen[r["place"]] += 1
        if n >= 20:
            assert all(abs(seen[p] - n * share[p] / total) < 4 for p in share)
    blocks = {}
    for r in slots:
        blocks.setdefault(r["place"], []).append(r["block"])
    assert all(b == list(range(len(b))) for b in blocks.values())


def test_one_source_and_none(docs_of):
    check(docs_of([(1, "a b c", "xx", None, 0)]), M.MixPlan())
    check(docs_of([(1, None, "xx", "s", 0), (2, "", "xx", "s", 0)]), M.MixPlan())
    assert M.mix(docs_of([])).count() == 0 and M.apply_mix(docs_of([])).count() == 0


def test_apply_mix_repeats_documents(docs_of):
    docs = docs_of([(i, "w " * 10, "xx", "ab"[i % 2], 0) for i in range(40)]).withColumn("copies", F.lit("x"))
    mixed = {r["doc_id"]: len(r["copy_slots"]) for r in M.mix(docs, M.MixPlan(block_words=7)).collect()}
    got = {}
    out = M.apply_mix(docs, M.MixPlan(block_words=7))
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in mixed.items() if n}


def test_mix_comes_in_the_order_of_the_schedule_with_any_column_names(docs_of):
    clashing = ("copy", "size_of_row", "mixed_id", "mixed_id_0", "slot_0", "row_size_0", "mixed_copies")
    docs = docs_of([(i, "w " * (5 + i % 9), "xx", "ab"[i % 2], 0) for i in range(60)]).withColumns({c: F.lit(c) for c in clashing})
    plan = M.MixPlan(block_words=7)
    out = M.apply_mix(docs, plan)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == c for r in rows for c in clashing)
    slots = {r["doc_id"]: sorted(r["copy_slots"]) for r in M.mix(docs, plan).collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, s in slots.items() for _ in s)
    seen = [s for i, s in sorted(((r, s) for r, all_ in slots.items() for s in all_), key=lambda x: (x[1], x[0]))]
    taken, at = {}, []
    for r in rows:
        k = taken.get(r["doc_id"], 0)
        taken[r["doc_id"]] = k + 1
        at.append(slots[r["doc_id"]][k])
    assert at == sorted(at) == seen
