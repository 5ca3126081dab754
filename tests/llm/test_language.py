import math
import random
import re

import pytest
from pyspark.sql import functions as F

from meltframe.llm import language as L


def text(language, n, seed):
    parts = {"aa": ["kata", "ri", "mo", "sun"], "bb": ["zwek", "ül", "pft", "gro"], "cc": ["oué", "ment", "çai", "le"]}[language]
    return " ".join(parts[(seed * 7 + i * i) % 4] + parts[(seed + i * 3) % 4] for i in range(n))


def labelled(docs_of):
    rows = [(i, text(lang, 40 + i % 5, i), lang, "s", 0) for i in range(60) for lang in [("aa", "bb", "cc")[i % 3]]]
    return docs_of(rows)


def brute(sample, whole):
    """Phrases by substring search in the sample, from the text's start to its end: cost, phrases, characters by language."""
    def coded(t):
        out = re.sub("\0+", "\0", "".join(c if c.isalpha() else "\0" for c in t.lower()))
        return out[1:] if out.startswith("\0") else out

    z, cost = coded(whole), {}
    for language, texts in sample.items():
        x, phrases, at = coded(" ".join(texts)), 0, 0
        while at < len(z):
            size = 0
            while at + size < len(z) and z[at:at + size + 1] in x:
                size += 1
            at, phrases = at + max(1, size), phrases + 1
        cost[language] = (phrases * math.log2(max(2, len(x))) / max(1, len(z)), phrases, len(z), len(set(x)), len(x))
    return cost


def explained(sample, whole):
    """The cheapest language, or None where listing the letters is no dearer than its phrases."""
    if not any(c.isalpha() for c in whole or ""):
        return None
    cost = brute(sample, whole)
    best = min(sorted(cost), key=lambda k: cost[k][0])
    _, phrases, n, letters, m = cost[best]
    return best if (phrases - 1) * math.log2(max(2, m)) < n * math.log2(max(2, letters)) else None


def test_automaton_accepts_exactly_the_substrings():
    codes = [1, 2, 1, 1, 2, 3, 1, 2, 1, 1, 3]
    states = L.suffix_automaton(codes)

    def accepts(word):
        state = 0
        for c in word:
            if c not in states[state]:
                return False
            state = states[state][c]
        return True

    inside = {tuple(codes[i:j]) for i in range(len(codes)) for j in range(i, len(codes) + 1)}
    from itertools import product
    for n in range(5):
        for word in product((1, 2, 3, 4), repeat=n):
            assert accepts(word) == (word in inside)


def mixed_texts():
    rng = random.Random(3)
    letters = "abkrtizweülpgméç漢字 -"
    known = text("aa", 30, 1)
    return [text("aa", 5, 9), text("bb", 400, 4), "Ünseen 漢字 kata", text("cc", 100, 5) + " " + text("aa", 90, 5), "oué", "ka漢ta漢ri", "zz" * 700,
            known, known * 3, "x " + known * 4 + " 漢", *["".join(rng.choices(letters, k=rng.choice([1, 30, 511, 512, 513, 1_700]))) for _ in range(60)]]


@pytest.mark.parametrize("dense_cells", [None, 3_000])
@pytest.mark.parametrize("lane", [512, 7])
def test_phrases_equal_brute_force(monkeypatch, dense_cells, lane):
    """Short lanes, and letters outside the table, change nothing."""
    monkeypatch.setattr(L, "LANE", lane)
    sample = {"aa": [text("aa", 30, 1)], "bb": [text("bb", 30, 2)], "cc": [text("cc", 30, 3), "ka"]}
    parser, texts = L.Parser(sample, dense_cells), mixed_texts()
    counts = parser.counts([parser.codes(t) for t in texts])
    for i, (whole, found) in enumerate(zip(texts, parser.identify(texts))):
        cost = brute(sample, whole)
        assert [cost[k][1] for k in parser.languages] == counts[:, i].tolist(), whole
        if found[0] != "und":
            best, second = sorted(c[0] for c in cost.values())[:2]
            assert cost[found[0]][0] == best and abs(found[1] - second / (best + second)) < 1e-9
        assert (found[0] if found[2] else None) == explained(sample, whole)


def test_large_alphabet():
    rng = random.Random(8)
    han = [chr(0x4E00 + i) for i in range(5_000)]
    sample = {"zh": ["".join(rng.choices(han, k=12_000)) + "".join(han)], "aa": [text("aa", 30, 1)]}
    parser = L.Parser(sample, dense_cells=200_000)
    texts = [sample["zh"][0][500:2_900], "".join(rng.choices(han, k=700)), text("aa", 50, 3), "漢 kata " * 40]
    counts = parser.counts([parser.codes(t) for t in texts])
    for i, whole in enumerate(texts):
        assert [brute(sample, whole)[k][1] for k in parser.languages] == counts[:, i].tolist()
    found = parser.identify(texts)
    assert (found[0][0], found[2][0]) == ("zh", "aa") and parser.automata[1].rare > 0


def test_held_out_accuracy_and_undetermined(docs_of):
    docs = labelled(docs_of)
    sample = L.training_sample(docs, F.col("doc_id") % 4 != 0)
    found = L.identify(docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)), sample)
    pairs = found.join(docs, "doc_id").where("doc_id % 4 = 0").select("lang", "lang_pred").collect()
    assert all(r["lang"] == r["lang_pred"] for r in pairs) and len(pairs) == 15
    odd = docs_of([(1, None), (2, ""), (3, "123 -- \n"), (None, "kata ri"), (5, "漢字"), (6, "mo " * 60_000), (6, "mo " * 60_000)])
    got = sorted(((r["doc_id"], r["lang_pred"], 0 <= r["score"] <= 1) for r in L.identify(odd, sample).collect()), key=str)
    assert [g[:2] for g in got if g[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert all(g[1] == "aa" for g in got if g[0] in (None, 6)) and all(g[2] for g in got)
    assert got[-1][0] is None and len(got) == 7


def test_without_labels_and_without_rows(docs_of):
    docs = docs_of([(1, "kata", None, "s", 0), (2, "ri", None, "s", 0)])
    assert L.training_sample(docs, F.lit(True)) == {}
    assert {r["lang_pred"] for r in L.identify(docs, {}).collect()} == {"und"}
    assert L.training_sample(docs_of([]), F.lit(True)) == {} and L.identify(docs_of([]), {"aa": ["x"]}).count() == 0


def test_keep_known(docs_of):
    sample = {"aa": [text("aa", 90, 1)], "bb": [text("bb", 90, 2)]}
    docs = docs_of([(1, "kata", None, "s", 0), (2, "12"), (3, None), (None, "zwek", "mine", "s", 0), (1, "kata", None, "s", 0), (4, "漢字漢字漢"), (5, "xyqj vbnm qyxv")])
    out = L.keep_known(docs.withColumn("lang_pred", F.lit("mine")), sample)
    assert out.columns == [*docs.columns, "lang_pred"]
    assert sorted((str(r["doc_id"]), r["lang"]) for r in out.collect()) == [("1", "aa"), ("1", "aa"), ("None", "mine")]


def test_sample_is_bounded_and_repeatable(docs_of, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_DOCS", 5)
    docs = labelled(docs_of)
    first, second = L.training_sample(docs, F.lit(True)), L.training_sample(docs.repartition(7), F.lit(True))
    assert first == second and all(len(t) == 5 for t in first.values())
    texts = {r["text"] for r in docs.collect()}
    assert all(t in texts for chosen in first.values() for t in chosen)  # whole ones
    monkeypatch.setattr(L, "SAMPLE_CHARS", 10)
    assert {k: len(v) for k, v in L.training_sample(docs_of([(i, "kata" * (1 + 9 * (i % 2)), "aa", "s", 0) for i in range(20)] + [(99, "z" * 30, "bb", "s", 0)]),
                                                    F.lit(True)).items()} == {"aa": 5, "bb": 1}
