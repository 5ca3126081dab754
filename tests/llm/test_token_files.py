import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meltframe.llm import token_files as T
from meltframe.llm import wordids as W

tokenizers = pytest.importorskip("tokenizers")

TEXTS = ["", " ", "  ", "   three", "two  blanks", "end ", "end  ", "a\n b", "a\n \nb", "tab \t x", "it's we'll I'd", "<|endoftext|> x <|endoftext|>",
         "naïve 中文 \U0001F600 ½² word.", "word, word; word: 12,345", " x", "\n", "word " * 60_000, "x" * 5_000, "é é", "a b c", "__under_score__"]


@pytest.fixture(scope="module")
def vocabulary(tokenizer):
    return tokenizer("byte_bpe_50k.json")


def expected(vocabulary, rows):
    library = tokenizers.Tokenizer.from_file(vocabulary)
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_equal_the_library(vocabulary, monkeypatch):
    monkeypatch.setattr(W, "REMEMBERED", 50)
    library, encoder, rng = tokenizers.Tokenizer.from_file(vocabulary), T.PieceEncoder(vocabulary), random.Random(2)
    letters = "abcdeéß'.,!? \n\t   0123½²  中_<|>"
    for text in TEXTS + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(800)]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    texts = TEXTS + [None] + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(2_000)]
    ids, bounds = encoder.encode_all(pa.array(texts, pa.string()).slice(3), 0)
    for text, a, b in zip(texts[3:], bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids + [0], text


def test_files_round_trip(docs_of, spark, vocabulary, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_BYTES", 60_000)  # several files
    rows = [(3 * i % 61 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (None, None), (7, "twice"), (7, "twice"), (7, "other")]
    docs = docs_of(rows).withColumn("row", F.lit("x")).withColumn("ids", F.lit(0)).repartition(5)
    T.write_tokens(docs, f"{tmp_path}/t", vocabulary)
    read = T.read_tokens(spark, f"{tmp_path}/t")
    got = T.digests(T.with_start(read)).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(vocabulary, rows)
    assert len(read.inputFiles()) > 2


def test_metadata_prunes(docs_of, spark, vocabulary, tmp_path):
    T.write_tokens(docs_of([(i, f"text {i}") for i in range(5_000)]), f"{tmp_path}/t", vocabulary)
    some = T.read_tokens(spark, f"{tmp_path}/t", [4_321])
    assert [r["doc_id"] for r in some.collect()] == [4_321]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters")[1][:120]
    few = T.read_tokens(spark, f"{tmp_path}/t").where(T.in_range(F.col("doc_id"), 10, 13))
    assert few.count() == 3
    orc = pytest.importorskip("pyarrow.orc")
    file = orc.ORCFile(some.inputFiles()[0].removeprefix("file://"))
    assert file.compression == "ZSTD" and file.row_index_stride == 1_000


def test_empty_table(docs_of, spark, vocabulary, tmp_path):
    T.write_tokens(docs_of([]), f"{tmp_path}/t", vocabulary)
    assert T.digests(T.with_start(T.read_tokens(spark, f"{tmp_path}/t"))).count() == 0
