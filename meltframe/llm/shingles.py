"""Word shingles of whole texts as 64-bit hashes, and HyperMinHash registers of such sets, over Arrow batches with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 4
# Registers of a signature; leading-zero count in the high bits of each, mantissa in the low ones.
REGISTERS, REGISTER_BITS = 256, 8
MANTISSA_BITS = 10
# Hashes a set is stretched to at least, per register, so that few registers stay empty.
FILL = 8
ROUND_BITS = 12

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Shingler:
    """Splits and hashes the texts of Arrow batches; holds the tables for that."""

    def __init__(self, words: int = WORDS):
        self.words = words
        codes = np.arange(256, dtype=np.uint8)
        self.lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint8)
        self.blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        self.value = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
        self._grow(1 << 17)

    def _grow(self, n: int) -> None:
        self.power, self.inverse = _powers(BASE, n + 1), _powers(BASE_INVERSE, n + 1)

    def word_hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every word data[start:end], from running sums over stretches of whole words."""
        out = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):
            low = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, low + (1 << 17), "right")))
            size = int(ends[last - 1] - low)
            if size >= len(self.power):
                self._grow(size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(self.value[data[low:low + size]] * self.power[:size], out=sums[1:])
            a, b = starts[first:last] - low, ends[first:last] - low
            out[first:last] = mixed((sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * STEP)
            first = last
        return out

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each text; nulls and texts without words give empty arrays."""
        texts = pa.array(texts.cast(pa.large_binary()).fill_null(b""), pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        data = self.lower[data]
        word = ~self.blank[data]
        before = np.concatenate([[False], word[:-1]]) if len(word) else word.copy()
        inner = offsets[offsets < len(data)]
        before[inner] = False
        starts = np.flatnonzero(word & ~before)
        after = np.concatenate([word[1:], [False]]) if len(word) else word.copy()
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        hashes = self.word_hashes(data, starts, ends)
        k = self.words
        folded = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for j in range(k):
            folded = folded * BASE + hashes[j:j + len(folded)]
        folded = mixed(folded)
        bounds = np.searchsorted(starts, offsets)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if high - low >= k:
                yield np.unique(folded[low:high - k + 1])
            elif high > low:
                whole = np.uint64(high - low)
                for h in hashes[low:high]:
                    whole = mixed(np.array([whole * STEP + h]))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def registers(items: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set, 16 bits each; zeros for an empty set.

    Every item is hashed in rounds. A register belongs to the first round that reaches it and, within it, to the smallest hash, of
    which the number of leading zeros and the bits after the first one are kept. The order (round, hash) is one random order per
    register, so two sets agree in a register with the probability of their Jaccard similarity, however small they are.
    """
    out = np.zeros(REGISTERS, np.uint16)
    if not len(items):
        return out
    empty = np.ones(REGISTERS, bool)
    rounds, done = max(1, -(-FILL * REGISTERS // len(items))), 0
    rest_bits = 64 - REGISTER_BITS - ROUND_BITS
    rounds = min(rounds, (1 << ROUND_BITS) - 1)
    while empty.any():
        seeds = np.arange(done, done + rounds, dtype=np.uint64)
        h = mixed(items[None, :] + (seeds[:, None] + np.uint64(1)) * STEP)
        keys = (h >> np.uint64(64 - REGISTER_BITS) << np.uint64(64 - REGISTER_BITS)) | (
            (seeds[:, None] - np.uint64(done)) << np.uint64(rest_bits)) | ((h << np.uint64(REGISTER_BITS)) >> np.uint64(64 - rest_bits))
        keys = np.sort(keys, axis=None)
        slot = (keys >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        slot, rest = slot[first], keys[first] & np.uint64((1 << rest_bits) - 1)
        fresh = empty[slot]
        slot, rest = slot[fresh], rest[fresh]
        # position of the highest bit of a number below 2^53 is exact in floating point
        high = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
        zeros = rest_bits - high
        below = np.maximum(high - 1, 0).astype(np.uint64)
        tail = rest & ((np.uint64(1) << below) - np.uint64(1))
        shift = below.astype(np.int64) - MANTISSA_BITS
        mantissa = np.where(shift >= 0, tail >> np.maximum(shift, 0).astype(np.uint64), tail << np.maximum(-shift, 0).astype(np.uint64))
        out[slot] = (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
        empty[slot] = False
        done += rounds
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` registers, for each signature (one per line)."""
    bands = REGISTERS // rows
    parts = signatures[:, :bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * STEP, parts.shape[:2]).copy()
    for j in range(rows):
        keys = mixed(keys + parts[:, :, j] * BASE)
    return keys.view(np.int64)


def collision_rate(load: np.ndarray) -> np.ndarray:
    """Probability that two registers with different minima look alike; `load`: items per register (at least 1)."""
    level = np.arange(44)
    over = (1 - 0.5 ** level) ** load[:, None]  # the smallest of the hashes exceeds 2^-level
    at = (1 - 0.5 ** (level + 1)) ** load[:, None] - over
    return (at * at).sum(axis=1) * 0.5**MANTISSA_BITS


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of paired signatures, corrected for accidental agreement of compressed registers."""
    agree = (a == b).mean(axis=1)
    rate = collision_rate(np.maximum(1.0, np.sqrt(size_a.astype(float) * size_b) / REGISTERS))
    return (agree - rate) / (1 - rate)
