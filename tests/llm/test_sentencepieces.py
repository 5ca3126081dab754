import hashlib
import random
import sys

import pytest
from pyspark.sql import functions as F

from meltframe.llm import sentencepieces as S

spm = pytest.importorskip("sentencepiece")

TEXTS = [None, "", " ", "  ", "   lead", "trail  ", "a", "\n", "\n\n x", "tab\tand\x00null", "▁ meta ▁▁", "ümläut 中文 \U0001F600‍", "<s> </s> <unk> <0x41>",
         "Hello world, this isn't a test... of 1234567 things!!", "x" * 5_000, "word " * 60_000, " 　 ", "a\r\nb", "�", "é vs é"]


@pytest.fixture(scope="module")
def model(tokenizer):
    return tokenizer("piece_bpe_32k.model")


def expected(model, texts):
    library = spm.SentencePieceProcessor(model_file=model)
    out = []
    for text in texts:
        ids = library.encode(text or "")
        out.append((ids, library.decode(ids)))
    return out


def test_whole_texts_equal_the_library(docs_of, model):
    docs = docs_of(list(enumerate(TEXTS))).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in S.encode(docs, model).collect()}
    assert [got[i] for i in range(len(TEXTS))] == expected(model, TEXTS)


def test_digests(docs_of, model):
    rows = [(None, "null id"), (1, "twice"), (1, "twice"), (2, None)]
    got = sorted(map(tuple, S.digests(docs_of(rows), model).collect()), key=str)
    want = sorted(((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                   for (i, _), (ids, text) in zip(rows, expected(model, [t for _, t in rows]))), key=str)
    assert got == want
    assert S.digests(docs_of([]), model).count() == 0


def test_random_strings_and_a_small_memory(model, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 40)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz      \n\t.,;'\"-0123456789éßñ中▁<>"
    texts = ["".join(rng.choices(letters, k=rng.randrange(300))) for _ in range(150)]
    encoder = S.SegmentEncoder(model)
    got = [([int(i) for i in ids.split(",")] if ids else [], text) for ids, text in encoder.encode(texts)]
    assert got == expected(model, texts)


def test_other_models_are_refused(model):
    def message(*parts):
        return b"".join(bytes([number << 3 | 2, len(value)]) + value if isinstance(value, bytes) else bytes([number << 3, value]) for number, value in parts)

    for model_bytes in (message((2, message((3, 1)))), message((3, message((4, 1)))), message((1, message((1, b"x"), (3, 4))))):
        with pytest.raises(ValueError):
            S.Agenda(model_bytes)


def test_remembered_segments_are_small(model):
    encoder = S.SegmentEncoder(model)
    words = [f"{'abcdefghij'[i % 10]}{i}" for i in range(2_000)]
    got = list(encoder.encode([" ".join(words)]))
    assert got == [(",".join(map(str, ids)), text) for ids, text in expected(model, [" ".join(words)])]
    held = [x for pair in encoder.known.items() for x in pair]
    assert all(isinstance(x, str) for x in held)
    assert sum(map(sys.getsizeof, held)) <= 150 * len(encoder.known)
