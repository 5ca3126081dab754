"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies: a score-ordered agenda of adjacent symbol pairs.

A text is normalised as the model says (blanks become U+2581, one is put in front), cut where no piece of the vocabulary can reach across,
and each segment is encoded by an agenda: all adjacent pairs that form a piece wait in a heap, best score first, leftmost first among
equals; the top pair is merged and its new neighbours join the agenda. Characters outside the vocabulary become their UTF-8 bytes.
Segments are remembered per worker, with their ids alone: a segment is kept with plain blanks, which is what its ids decode to. All segments
that are new in an Arrow batch are also given to the sentencepiece library, and a difference in ids or decoded text is an error.

Models other than BPE with byte fallback, a blank in front and no rewriting of characters are refused.

Defined results: null text is empty and has no ids; rows are independent, so repeated rows, ties and null ids change nothing; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltframe.llm.common import per_worker, tidy

BLANK = "▁"
# Segments of a generation in a worker's memory; when one is full, the one before it is forgotten.
REMEMBERED = 400_000
# Piece types and the model type in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def fields(message: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(field number, value) of a protobuf message: bytes for strings and messages, whole numbers for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = message[at:at + size], at + size
        yield tag >> 3, value


class Agenda:
    """The vocabulary's pieces and the merge procedure."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for number, value in fields(model):
            if number == 1:
                piece = {1: b"", 2: bytes(4), 3: NORMAL} | dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]))
                self.kinds.append(piece[3])
            elif number == 2:
                if dict(fields(value)).get(3, 1) != BPE:
                    raise ValueError("only merge-type vocabularies are encoded by an agenda")
            elif number == 3:
                rules = {2: b"", 3: 1, 4: 1, 5: 1} | dict(fields(value))
                if rules[2] or rules[4] or not rules[3] or not rules[5]:
                    raise ValueError("the model rewrites characters or blanks in a way that is not supported")
        if not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        # a piece's rank in the agenda and its id; lower ranks first
        self.rank = {p: (-s, i) for i, (p, s, k) in enumerate(zip(self.pieces, scores, self.kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        inner = [p for p in self.rank if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in inner):
            raise ValueError("a piece reaches from one word into the next")
        # a line feed is cut off too where no piece holds one beside other characters
        line = "" if any("\n" in p for p in inner) else "\n"
        # marks that no piece joins to a letter before them
        self.marks = "".join(m for m in ".,;:!?" if not any(x.isalpha() and y == m for p in inner for x, y in zip(p, p[1:])))
        self.cut = re.compile(f" +[^ {line}]*|[^ {line}]+" + (f"|{line}" if line else ""))

    def segments(self, text: str) -> list[str]:
        """The text, U+2581 and blanks alike as blanks and one in front, in parts that no merge can join."""
        return self.cut.findall(" " + text.replace(BLANK, " ")) if text else []

    def encode(self, segment: str) -> list[int]:
        symbols: list[str | None] = list(segment.replace(" ", BLANK))
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        agenda = []
        for i in range(n - 1):
            found = rank.get(symbols[i] + symbols[i + 1])
            if found:
                agenda.append((found[0], i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            # stale if one of the two was merged since
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, None
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                joined = piece + symbols[nxt]
                if found := rank.get(joined):
                    heapq.heappush(agenda, (found[0], left, nxt, joined))
            prev = before[left]
            if prev >= 0:
                joined = symbols[prev] + piece
                if found := rank.get(joined):
                    heapq.heappush(agenda, (found[0], prev, left, joined))
        out = []
        for symbol in symbols:
            if symbol is not None:
                found = rank.get(symbol)
                out.extend([found[1]] if found else [self.bytes[b] for b in symbol.encode()])
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids without the blank in front that encoding adds; broken byte sequences become U+FFFD."""
        out = b"".join(bytes([int(self.pieces[i][3:5], 16)]) if self.kinds[i] == BYTE else
                       self.pieces[i].encode() if self.kinds[i] == NORMAL else b"" for i in ids)
        return out.decode("utf-8", "replace").replace(BLANK, " ").removeprefix(" ")


class SegmentEncoder:
    """An agenda with its memory and the library it is held against."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.agenda = Agenda(self.library.serialized_model_proto())
        # ids as decimal text joined by commas of each segment; two generations
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def recall(self, segment: str) -> str | None:
        """The ids remembered of a segment, or of the word and the mark it consists of."""
        found = self.known.get(segment) or self.older.get(segment)
        if found is None and segment[-1] in self.agenda.marks and segment[-2:-1].isalpha():
            word, mark = self.recall(segment[:-1]), self.recall(segment[-1])
            if word and mark:
                found = f"{word},{mark}"
        return found

    def learn(self, new: list[str]) -> dict[str, str]:
        """Encode new segments and compare with the library; decode the ids, which must give the segment itself."""
        # alone, a segment that starts within a word would get a blank in front: it is shown to the library after a line feed
        inner = [not s.startswith(" ") for s in new]
        lead = len(self.library.encode("\n"))
        shown = self.library.encode(["\n" + s if i else s[1:] for s, i in zip(new, inner)], num_threads=1)
        out = {}
        for segment, inside, theirs in zip(new, inner, shown):
            ids = self.agenda.encode(segment)
            theirs = theirs[lead:] if inside else theirs
            # the library gives no ids for the blank in front alone
            if ids != theirs and segment != " ":
                raise ValueError(f"the agenda and the library differ on {segment!r}: {ids} and {theirs}")
            text = self.agenda.decode(ids)
            if not inside:
                text = " " + text
            if text != segment:
                raise ValueError(f"decoding does not give back {segment!r}")
            out[segment] = ",".join(map(str, ids))
        return out

    def remember(self, found: dict[str, str]) -> None:
        if len(self.known) + len(found) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update(found)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        cut = [self.agenda.segments(t) for t in texts]
        found = [list(map(self.known.get, segments)) for segments in cut]
        missing = {s for segments, f in zip(cut, found) if None in f for s, x in zip(segments, f) if x is None}
        if missing:
            # a word with a mark behind it is known where both are; the word is learned, not the pair
            bare = {s[:-1] if s[-1] in self.agenda.marks and s[-2:-1].isalpha() else s for s in missing} | set(self.agenda.marks)
            fresh = self.learn([s for s in bare if self.recall(s) is None])
            self.known.update(fresh)
            recalled = {s: self.recall(s) for s in missing}
            self.remember(recalled)
            found = [[recalled[s] if x is None else x for s, x in zip(segments, f)] if None in f else f for segments, f in zip(cut, found)]
        for segments, f in zip(cut, found):
            # every segment is the text its ids decode to; the blank in front goes
            yield ",".join(f), "".join(segments)[1:]


def _encoded(path: str, names: list[str], types: list, row: Callable[[str, str], tuple]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("segment encoder", path), lambda: SegmentEncoder(path))
        for whole in batches:
            for batch in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                rows = [row(ids, text) for ids, text in encoder.encode([t or "" for t in batch["text"].to_pylist()])]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *names])
        tidy()
    return encode


def _ids(joined: str) -> np.ndarray:
    return np.array(joined.split(",") if joined else [], np.int32)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, decoded of every whole text; `model` is the model file's path, the same on every machine."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    make = _encoded(model, ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()], lambda ids, text: (_ids(ids), text))
    return rows.mapInArrow(make, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, from the same pass."""
    def row(ids: str, text: str) -> tuple:
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    make = _encoded(model, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], row)
    return rows.mapInArrow(make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
