import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meltframe.llm import language, mixing, queries, stages
from test_language import explained

spm = pytest.importorskip("sentencepiece")

UPPER = {c: c + 32 for c in range(65, 91)}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = random.Random(9)
    vocabulary = {"en": ["the", "house", "stands", "on", "hill", "river", "green", "walk", "slowly", "north"],
                  "de": ["das", "haus", "über", "hügel", "fluß", "grün", "geht", "langsam", "norden", "wörter"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.randrange(20, 200)))
        rows.append((i, text, lang, ["a", "b", None][i % 7 % 3]))
    for i in range(60, 75):  # exact copies in other letters, near copies, empty ones
        text = rows[i - 50][1]
        near = text.split()
        near[len(near) // 2] = "otherword"
        rows.append((i, text.upper() if i % 3 == 0 else " ".join(near) if i % 3 == 1 else ["", "123 --", None][i % 9 // 3], None, "a"))
    # letters without a language
    rows += [(75, "".join(rng.choice("漢字仮名交") for _ in range(300)), None, "a"), (76, "".join(rng.choice("αβγδε ζη") for _ in range(300)), None, "b")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def brute(rows, model, sample):
    rows = [r for r in rows if explained(sample, r[1])]
    best = {}
    for r in rows:
        key = r[1].translate(UPPER)
        best[key] = max(r[0], best.get(key, r[0]))
    rows = [r for r in rows if best[r[1].translate(UPPER)] == r[0]]
    sets = {}
    for r in rows:
        w = words(r[1].translate(UPPER))
        sets[r[0]] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    name = {i: i for i in sets}

    def root(i):
        return i if name[i] == i else root(name[i])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    rows = [r for r in rows if root(r[0]) == r[0]]
    size = {r[0]: len(words(r[1])) for r in rows}
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(total.values()), set(sources), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]} or open_
        if over is open_:
            target |= share
        else:
            target |= {s: 2.0 * total[s] for s in over}
            left -= sum(target[s] for s in over)
        open_ = open_ - over
    out = []
    library = spm.SentencePieceProcessor(model_file=model)
    for s in sources:
        at, limit = 0, math.floor(target[s] + 1e-9)
        inside = [r for r in rows if r[3] == s]
        inside.sort(key=lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16), r[0]))
        for r in inside:
            ids = library.encode(r[1])
            row = (r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
            out += [row] * ((at < limit) + (at + total[s] < limit))
            at += size[r[0]]
    return sorted(out)


def test_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    sample = language.training_sample(spark.read.parquet(f"{tmp_path}/documents.parquet"), F.lit(True))
    want = brute(rows, queries.tokenizer("piece_bpe_32k.model"), sample)
    assert got == want and not {i for i, *_ in want} & {75, 76}


def test_stages_return_the_columns_of_documents(docs_of, spark):
    assert [f for _, f in corpus_pipeline.STAGES] == [
        stages.language_id, stages.exact_dedup, stages.near_dedup, stages.source_mixing, stages.sentencepiece]
    empty = docs_of([])
    odd = docs_of([(None, "null id", None, None, None), (1, "kept text here", "en", None, 3), (1, "kept text here", "en", None, 3)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == COLUMNS
        out = stage(spark, empty, "")
        assert out.columns == COLUMNS and out.count() == 0
    assert stages.sentencepiece(spark, empty, "").count() == 0


def test_queries_are_registered():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert names == [f"op{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 11, 12)]
    assert mixing.MixPlan().share == 1.5 and F is not None
