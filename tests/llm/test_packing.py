"""Packing against the tokenizers library and a best-fit of all pieces at once: whole ids, gapless bins, few sequences."""

import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltframe.llm import packing

tokenizers = pytest.importorskip("tokenizers")


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def encode_all(path, texts):
    library = tokenizers.Tokenizer.from_file(path)
    return [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0
        for (a, n), (b, _) in zip(places, places[1:]):
            assert a + n == b
        assert sum(places[-1]) <= capacity
    return len(bins)


def check(docs, texts, path, capacity, **options):
    found = packing.pack(docs, path, capacity=capacity, **options).collect()
    want = []
    for (doc_id, _), ids in zip(texts, encode_all(path, [t for _, t in texts])):
        want += [(doc_id, k, s, len(ids[s:s + capacity]), crc(ids[s:s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in found)
    count = check_bins(found, capacity)
    best = len(packing.best_fit(np.array([w[3] for w in want], np.int64), capacity)[2]) if want else 0
    assert count <= best * 1.02 + 1
    return found


def some_texts(rng, n):
    words = ["the", "Ünïcode", "don't", "漢字", "x1y22", "a--b", "end.", "MiXed,", " odd blank", "é", "<|endoftext|>", "ΣΑΣ", "ﬁ", "\x0b", "tab\there", "\r\n", "  ", "'s", "!?", "İ"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(n)]


def test_ids_and_bins(docs_of, tokenizer):
    rng = random.Random(1)
    texts = some_texts(rng, 300) + [(1_000, None), (1_001, ""), (1_002, "word " * 5_000), (7, "again"), (7, "again"), (None, "no id"), (1_003, "\n\n \t")]
    docs = docs_of(texts).withColumns({c: F.lit("x") for c in ("piece", "bin", "offset", "fill", "into", "shift")})
    check(docs.repartition(7), texts, tokenizer("word_bpe_49k.json"), 128)


def test_tree_of_many_rounds(docs_of, tokenizer):
    """Small local groups and nodes: several rounds, bins that move more than once, nodes packed in parts."""
    rng = random.Random(2)
    texts = [(i, "word " * rng.choice([1, 2, 3, 20, 21, 22, 35])) for i in range(900)]
    check(docs_of(texts).repartition(20), texts, tokenizer("word_bpe_49k.json"), 64, slack=0, local_items=16, group_items=24)


def test_copies_only_and_empty(docs_of, tokenizer):
    path = tokenizer("word_bpe_49k.json")
    check(docs_of([(i, "same text here") for i in range(500)]), [(i, "same text here") for i in range(500)], path, 16)
    assert packing.pack(docs_of([]), path).collect() == []


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fills = packing.best_fit(np.array([5, 4, 3, 3, 2, 1]), 8)
    assert fills.tolist() == [8, 8, 2] or sorted(fills.tolist()) == [2, 8, 8]
    assert len(set(zip(bins.tolist(), offsets.tolist()))) == 6
