"""Token ids of whole Arrow batches of texts: texts are cut into parts, each different part of a batch is encoded once, and ids are gathered.

Cutting, factorising and gathering are Arrow and NumPy passes over the batch; the library sees a part only when a worker meets it for the
first time (or again after it was forgotten).
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Parts of a generation in a worker's memory; when one is full, the one before it is forgotten.
REMEMBERED = 500_000
# Bytes of text handled at once, unless one text is longer.
BYTES_AT_ONCE = 8 << 20


class Memory:
    """Ids of parts as little-endian bytes, two generations of them; None for a part whose text must be encoded as a whole."""

    ODD = 0

    def __init__(self, make: Callable[[str], bytes | None]):
        self.make = make
        self.young: dict[str, bytes | int] = {}
        self.old: dict[str, bytes | int] = {}

    def _remember(self, part: str) -> bytes | int:
        known = self.old.get(part)
        if known is None:
            known = self.make(part)
            if known is None:
                known = self.ODD
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[part] = known
        return known

    def get(self, part: str) -> bytes | None:
        known = self.young.get(part)
        if known is None:
            known = self._remember(part)
        return None if known is self.ODD else known

    def get_all(self, parts: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of different parts (empty for odd ones), and the places of the odd ones."""
        known = list(map(self.young.get, parts))
        known = [self._remember(p) if k is None else k for p, k in zip(parts, known)]
        odd = [i for i, k in enumerate(known) if k is self.ODD] if self.ODD in known else []
        for i in odd:
            known[i] = b""
        return known, odd


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def slices(batch: pa.RecordBatch, column: str = "text", size: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `size` bytes of text; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def gather(parts: pa.Array, bounds: np.ndarray, memory: Memory, end_id: int | None,
           whole: Callable[[int], bytes], first: Callable[[str], bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's ids begin (one more than texts).

    `parts` are the parts of all texts, text i having parts bounds[i]:bounds[i + 1] and at least one. Where the memory has None for a
    part, the text's ids come from `whole(i)`. A text's first part is encoded by `first`, if that is given.
    """
    coded = parts.dictionary_encode()
    words = coded.dictionary.to_pylist()
    known, odd = memory.get_all(words)
    codes = coded.indices.to_numpy()
    if odd or first:
        codes = codes.copy()
    nothing = len(known)
    known.append(b"")
    begin = codes[bounds[:-1]]
    if odd:
        is_odd = np.zeros(nothing, bool)
        is_odd[odd] = True
        hit = np.concatenate([[0], np.cumsum(is_odd[codes])])
        for i in np.flatnonzero(hit[bounds[1:]] > hit[bounds[:-1]]).tolist():
            # the text's first part stands for all of it, its other parts for nothing
            codes[bounds[i]:bounds[i + 1]] = nothing
            codes[bounds[i]] = len(known)
            known.append(whole(i))
            begin[i] = -1
    if first:
        for i, code in enumerate(begin.tolist()):
            if code >= 0:
                codes[bounds[i]] = len(known)
                known.append(first(words[code]))
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    flat = np.frombuffer(b"".join(known), "<u4")
    counts = sizes[codes]
    ends = np.cumsum(counts)
    starts = np.concatenate([[0], ends])[bounds]
    total = int(starts[-1])
    # where a part's ids lie in `flat`, less where they go; all of it fits 32 bits unless a text is very long
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    shift = ((np.cumsum(sizes) - sizes)[codes] - (ends - counts)).astype(kind)
    source = np.repeat(shift, counts)
    source += np.arange(total, dtype=kind)
    ids = flat[source]
    if end_id is not None:
        n = len(bounds) - 1
        ids = np.insert(ids, starts[1:], np.uint32(end_id))
        starts = starts + np.arange(n + 1)
    return ids, starts


def part_bounds(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of a list array and the bounds of each list in them."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
