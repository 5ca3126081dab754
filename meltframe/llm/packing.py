"""Best-fit packing in a hierarchy: tasks pack their own documents, and only bins with room left travel on, as items.

1. Each task tokenises its documents, cuts the long ones, and packs the pieces best-fit (largest first, into the fullest bin that has
   room), some `LOCAL_ITEMS` at a time. Nothing is shuffled: a piece's bin and place are columns of the piece.
2. Bins with at most `SLACK` tokens of room are finished. The others are items of a tree over the tasks: eight neighbouring nodes' open
   bins meet in one, where best-fit runs again, with whole bins as items and their fill as size. Finished bins leave, the rest goes up.
3. A node with more than `GROUP_ITEMS` open bins is packed in that many parts; as soon as all open bins fit one node, that is the root.
The moves of bins (into which bin, how far along) are composed round by round and applied to the pieces at the end in one join, which
only bins that moved take part in.

Defined results: null text is empty, so its document is the end id alone; a document of at most `capacity` ids is one piece; longer ones
are cut every `capacity` ids; rows that repeat a doc_id are documents of their own; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltframe.llm import wordids
from meltframe.llm.common import maybe_broadcast, per_worker
from meltframe.session import free, stored

CAPACITY = 2_048
# Room a finished bin may have.
SLACK = 8
# Pieces a task packs at a time, and open bins that one node of the tree takes.
LOCAL_ITEMS = 65_536
GROUP_ITEMS = 65_536
FAN_IN_BITS = 3
# Runs of marks a worker remembers.
MARKS_REMEMBERED = 10_000
PART_BITS = 33

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
MOVE_SCHEMA = "bin long, into long, shift long, fill long"


class WordEncoder:
    """Ids of texts by a vocabulary that drops white space, so that words are encoded apart."""

    # Latin letters whose lower case does not depend on their neighbours and that compose with nothing, then ASCII marks
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        as_text = ByteLevel(add_prefix_space=False, use_regex=False)
        # the byte-level alphabet's form of each letter
        self.letters = {i: as_text.pre_tokenize_str(chr(i))[0][0] for i in range(0x80, 0x180)}
        self.marks: dict[str, bytes] = {}
        self.memory = wordids.Memory(self.word)

    def by_library(self, text: str) -> bytes:
        return wordids.packed(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def word(self, text: str) -> bytes:
        """Ids of a part of a document without ASCII white space."""
        plain = self.PLAIN.fullmatch(text)
        if not plain:
            return self.by_library(text)
        core, tail = plain.groups()
        if tail:
            # letters are one word of the pre-tokeniser, the marks after them another
            if tail not in self.marks:
                if len(self.marks) >= MARKS_REMEMBERED:
                    self.marks.clear()
                self.marks[tail] = self.by_library(tail)
            return self.memory.get(core) + self.marks[tail]
        lower = core.lower()
        return wordids.packed([t.id for t in self.model.tokenize(lower if lower.isascii() else lower.translate(self.letters))])

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (unsigned), and where each text's begin."""
        parts, bounds = wordids.part_bounds(pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null("")))
        return wordids.gather(parts, bounds, self.memory, end_id, lambda i: b"")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin: largest first, each into the fullest bin that has room."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    order = np.argsort(-sizes, kind="stable")
    placed, places = [], []
    for size in sizes[order].tolist():
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            waiting = with_room[room]
            b = waiting.pop()
            if not waiting:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        placed.append(b)
        places.append(fills[b])
        fills[b] += size
        left = room - size
        if left:
            with_room[left].append(b)
            rooms |= 1 << left
    bins[order], offsets[order] = placed, places
    return bins, offsets, np.array(fills, np.int64)


def pieces_of(ids: np.ndarray, bounds: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Row, piece, start, length and checksum of the pieces of all texts."""
    lengths = np.diff(bounds)
    counts = -(-lengths // capacity)
    row = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = piece * capacity
    length = np.minimum(capacity, lengths[row] - start)
    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    at = bounds[row] + start
    sums = np.fromiter((zlib.crc32(view[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())), np.int64, len(row))
    return row, piece, start, length, sums


def pack_locally(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, local_items: int = LOCAL_ITEMS) -> DataFrame:
    """A row per piece with its bin, its place there and the bin's fill, each task's documents packed among themselves."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("word encoder", tokenizer), lambda: WordEncoder(tokenizer))
        first_bin = TaskContext.get().partitionId() << PART_BITS
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first_bin
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            bins, offsets, fills = best_fit(table["length"].to_numpy(), capacity)
            table = table.append_column("bin", pa.array(first_bin + bins)).append_column("offset", pa.array(offsets)).append_column(
                "fill", pa.array(fills[bins]))
            first_bin += len(fills)
            yield from table.to_batches(max_chunksize=20_000)

        for whole in batches:
            for batch in wordids.slices(whole):
                row, piece, start, length, sums = pieces_of(*encoder.encode(batch["text"], end_id), capacity)
                held.append(pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, sums))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"]))
                if sum(b.num_rows for b in held) >= local_items:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pack, PIECE_SCHEMA)


def _pack_node(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        # the order of rows in a group is the shuffle's, so it is fixed here: a task that runs again gives the same bins
        table = table.sort_by([("fill", "descending"), ("bin", "ascending")])
        ids, sizes = table["bin"].to_numpy(), table["fill"].to_numpy()
        bins, shifts, fills = best_fit(sizes, capacity)
        first = np.empty(len(fills), np.int64)
        first[bins[shifts == 0]] = ids[shifts == 0]  # a bin keeps the name of the one it began with
        return pa.table({"bin": ids, "into": first[bins], "shift": shifts, "fill": fills[bins]})
    return pack


def merge_open(opened: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, group_items: int = GROUP_ITEMS) -> DataFrame | None:
    """(bin, into, shift) of every open bin after all rounds; `opened` is stored and has bin and fill. None where there are none."""
    moves, level = None, 0
    while n := opened.count():
        level += 1
        node = F.shiftright("bin", PART_BITS + FAN_IN_BITS * level) if n > group_items else F.lit(0).cast("bigint")
        placed = opened.withColumn("node", node)
        if n > group_items:
            crowd = stored(placed.groupBy("node").agg(F.ceil(F.count("*") / group_items).cast("int").alias("parts")))
            placed = placed.join(maybe_broadcast(crowd, crowd.count()), "node").withColumn("part", F.pmod(F.xxhash64("bin"), F.col("parts")))
            root = crowd.count() == 1
        else:
            placed, root = placed.withColumn("part", F.lit(0).cast("bigint")), True
        step = stored(placed.select("node", "part", "bin", "fill").groupBy("node", "part").applyInArrow(_pack_node(capacity), MOVE_SCHEMA))
        if moves is None:
            moves = step.select("bin", "into", "shift")
        else:
            nxt = step.select(F.col("bin").alias("of"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moves = stored(moves.join(nxt, F.col("into") == F.col("of"), "left").select(
                "bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
        if root:
            break
        opened = stored(step.where(f"shift = 0 and fill < {capacity - slack}").select(F.col("into").alias("bin"), "fill"))
    return moves


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, slack: int = SLACK,
         local_items: int = LOCAL_ITEMS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    packed = stored(pack_locally(docs, tokenizer, end_id, capacity, local_items))
    # every bin has one piece at its beginning
    opened = stored(packed.where(f"offset = 0 and fill < {capacity - slack}").select("bin", "fill"))
    moves = merge_open(opened, capacity, slack, group_items)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return packed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    moved = stored(moves.where("bin <> into").select(F.col("bin").alias("of"), "into", "shift"))
    free(opened)
    joined = packed.join(maybe_broadcast(moved, moved.count()), F.col("bin") == F.col("of"), "left")
    return joined.select(*columns, F.coalesce("into", "bin").alias("sequence_id"),
                         (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
