import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meltframe.llm import near_dedup as N
from meltframe.llm import shingles as S
from meltframe.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k=4):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    name = {i: i for i, _ in rows}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for n, (a, sa) in enumerate(sets):
        for b, sb in sets[:n]:
            if None not in (a, b) and sa and 100 * len(sa & sb) >= 80 * len(sa | sb):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def corpus(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3_000)]
    rows, base = [], [rng.choices(vocabulary, k=rng.choice([3, 5, 9, 30, 120, 700])) for _ in range(40)]
    for words in base:
        rows.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            changed = list(words)
            for _ in range(rng.choice([1, 1, 2, len(words) // 40, len(words) // 25 + 1])):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append(" ".join(changed).upper())
    # a chain in which only neighbours are near
    chain = rng.choices(vocabulary, k=200)
    for i in range(12):
        chain = chain[3:] + rng.choices(vocabulary, k=3)
        rows.append("\n".join(chain))
    # many documents around one passage, too different to be linked
    passage = rng.choices(vocabulary, k=60)
    rows += [" ".join(passage + rng.choices(vocabulary, k=45)) for _ in range(40)]
    rows += [None, "", " \t\n", "one", "one", "ONE", "one two three four", "one two three four five", "x " * 60_000]
    return list(enumerate(rows))


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_equals_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = corpus()
    rows += [(None, "null id"), (None, "null id"), (5, rows[5][1]), (5, rows[5][1])]
    docs = docs_of(rows).withColumn("signature", F.lit(0)).withColumn("cid", F.lit("x")).withColumn("kept", F.lit(1))
    out = N.near_groups(docs)
    assert found(out) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_many_near_copies_of_one_text(docs_of):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(150), 3):
            words[at] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert found(N.near_groups(docs_of(rows))) == brute(rows)


def test_drop_near_copies(docs_of):
    rows = corpus(11) + [(None, "lonely"), (None, "lonely"), (2, "another text under a used number")]
    docs = docs_of(rows).withColumn("gone_id", F.lit(1))
    out = N.drop_near_copies(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    want = {i for i, _, c in brute(rows[:-3], 5) if i == c}
    assert kept.count(None) == 2 and set(kept) - {None} == want and len(kept) == len(want) + 2


def test_empty_table(docs_of):
    assert N.near_groups(docs_of([])).count() == 0 and N.drop_near_copies(docs_of([])).count() == 0


def test_sets_match_words_in_any_slice():
    texts = [None, "", "a b c d e", "A  b\tC d\x0be", "ä b c d", " lead and trail ", "x" * 400_000 + " y z q", "a b", "a b c d e"]
    shingler = S.Shingler()
    sizes = [len(s) for s in shingler.sets(pa.array(texts))]
    assert sizes == [len(shingle_set(t)) for t in texts]
    sliced = list(shingler.sets(pa.array(["zzz", *texts]).slice(1)))
    whole = list(shingler.sets(pa.array(texts)))
    assert all((a == b).all() for a, b in zip(sliced, whole)) and (whole[2] == whole[3]).all()


@pytest.mark.parametrize("size", [1, 4, 40, 900, 6_000])
@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_estimates_are_unbiased_at_every_size(size, similarity):
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(30):
        common = max(1, round(2 * size * similarity / (1 + similarity)))
        items = rng.integers(1, 2**63, 2 * size + 2, dtype=np.uint64)
        a, b = items[:size], np.concatenate([items[:common], items[size:2 * size - common]])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = S.estimate(S.registers(a)[None], S.registers(b)[None], np.array([size]), np.array([len(b)]))[0]
        errors.append(got - exact)
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 6 * 0.5 / 16


def test_components_of_paths_stars_and_cliques(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 130)] + [(200, 200 + i) for i in range(1, 60)] + [(300 + i, 300 + j) for i in range(6) for j in range(i)]
    links += [(400, 401), (401, 400), (500, 500)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: i // 100 * 100 for a, b in links for i in (a, b) if a != b}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
