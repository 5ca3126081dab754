"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids, stripes as units of reading.

Documents are ranged and sorted by id, encoded, and written as ORC: `ids` is a list of integers, which ORC packs by run-length encoding;
every stripe has row indexes with the range of ids, and a Bloom filter tells whether a stripe can hold an id. A reader gets several
tasks per file (stripes are read apart), and a filter on doc_id skips files, stripes and row groups by that metadata alone.

A file row is doc_id, row (position in its file), ahead (ids before it in its file), n_tokens, ids. Positions over all files follow from
a sum of ids per file, so no single task passes over the rows.

Encoding is the tokenizers library's, one piece of text at a time: a blank between two other characters always starts a new token of
the byte-level pre-tokeniser, so texts are cut there, a batch of them at once; each different piece is encoded once per worker and
remembered, and ids are gathered. Texts in which blanks stand in a run with other white space are cut one by one, or encoded whole.

Defined results: null text is empty, so its document is the end id alone; null doc_ids come first; rows with equal ids follow each
other in order of their text; an empty table gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from meltframe.llm import wordids
from meltframe.llm.common import maybe_broadcast, per_worker
from meltframe.session import stored

FILE_SCHEMA = "doc_id long, row long, ahead long, n_tokens int, ids array<int>"
# Bytes of the documents' table a file takes, about.
FILE_BYTES = 256 << 20
# Runs of marks a worker remembers.
MARKS_REMEMBERED = 10_000


class PieceEncoder:
    """Ids of whole texts as little-endian bytes, equal to the library's."""

    # a blank that has white space on both sides, or ends the text after some: its neighbours belong to one token
    JOINED = re.compile(r"\s (?:\s|\Z)")
    # Latin letters, then ASCII marks
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ſ]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        as_text = ByteLevel(add_prefix_space=False, use_regex=False)
        # the byte-level alphabet's form of letters and of a blank
        self.letters = {i: as_text.pre_tokenize_str(chr(i))[0][0] for i in range(0x80, 0x180)}
        self.blank = as_text.pre_tokenize_str(" ")[0][0]
        self.line = self.by_library("\n")
        self.marks: dict[str, bytes] = {}
        self.pieces = wordids.Memory(self.piece_of)

    def by_library(self, text: str) -> bytes:
        return wordids.packed(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def word(self, blank: str, text: str) -> bytes:
        """Ids of a part of a document without blanks; `blank` stands before it or nothing does."""
        plain = self.plain(blank, text)
        if plain is not None:
            return plain
        if "\n" in text:
            first, *lines = text.split("\n")
            # a line feed between two other characters is a token of its own
            if first and all(lines) and not any(c.isspace() for line in (first, *lines) for c in (line[0], line[-1])):
                return (self.piece(first) if blank else self.word(blank, first)) + b"".join([self.piece("\n" + x) for x in lines])
        return self.by_library(blank + text)

    def plain(self, blank: str, text: str) -> bytes | None:
        """Ids of a Latin word with marks behind it; None for anything else."""
        found = self.PLAIN.fullmatch(text)
        if not found:
            return None
        core, tail = found.groups()
        if tail:
            # letters are one token of the pre-tokeniser, the marks after them another
            return (self.piece(core) if blank else self.word(blank, core)) + self.tail(tail)
        # the model alone decides; it reads the byte-level alphabet
        letters = core if core.isascii() else core.translate(self.letters)
        return wordids.packed([t.id for t in self.model.tokenize(self.blank + letters if blank else letters)])

    def tail(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= MARKS_REMEMBERED:
                self.marks.clear()
            self.marks[marks] = self.by_library(marks)
        return self.marks[marks]

    def piece(self, part: str) -> bytes:
        """Ids of a blank and `part`, a part of a document without blanks; of `part` alone where it begins with a line feed."""
        known = self.pieces.get(part)
        return self.word(" ", part) if known is None else known

    def piece_of(self, part: str) -> bytes | None:
        """The same, or None where the blank or line feed before or after may be in a run of white space."""
        plain = self.plain(" ", part)
        if plain is not None:
            return plain
        line = part[:1] == "\n"
        text = part[1:] if line else part
        if not text or text[0].isspace() or text[-1].isspace():
            return None
        return self.line + self.word("", text) if line else self.word(" ", text)

    def encode(self, text: str) -> bytes:
        if self.JOINED.search(text):
            return self.by_library(text)
        first, *rest = text.split(" ")
        # a part that begins with a line feed has a blank before it here
        return b"".join([self.first(first), *[self.word(" ", part) if part[:1] == "\n" else self.piece(part) for part in rest]])

    def first(self, text: str) -> bytes:
        return self.word("", text)

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (unsigned), and where each text's begin."""
        texts = texts.cast(pa.large_string()).fill_null("")
        # a line feed begins a part too; where there was a blank before it, an empty part comes first and the text is cut by itself
        parts, bounds = wordids.part_bounds(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "))
        return wordids.gather(parts, bounds, self.pieces, end_id, lambda i: self.encode(texts[i].as_py()), self.first)


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("piece encoder", path), lambda: PieceEncoder(path))
        row = ahead = 0
        for whole in batches:
            for batch in wordids.slices(whole):
                ids, offsets = encoder.encode_all(batch["text"], end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                rows = pa.array(np.arange(row, row + batch.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], rows, pa.array(ahead + offsets[:-1]), pa.array(np.diff(offsets).astype(np.int32)), lists],
                    ["doc_id", "row", "ahead", "n_tokens", "ids"])
                row, ahead = row + batch.num_rows, ahead + int(offsets[-1])
    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, text_bytes: int | None = None) -> None:
    """ORC files of the documents' ids in ascending doc_id order; `tokenizer` is the vocabulary file's path."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    if text_bytes is None:
        # what the files say; a table that is not read from files is measured
        text_bytes = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if text_bytes >= 1 << 60:
            text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    files = max(int(parts) if int(parts) * (1 << 20) < text_bytes else 1, math.ceil(text_bytes / FILE_BYTES))
    ordered = docs.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    rows = ordered.mapInArrow(_encode(tokenizer, end_id), FILE_SCHEMA)
    (rows.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with some ids, only the files, stripes and row groups that can hold them are read."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def with_start(rows: DataFrame) -> DataFrame:
    """`start`: the ids of all documents before, over all files in the order of their documents."""
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(F.struct("doc_id", "row")).alias("first"))
    # one row per file; equal ids are never in two files, and only the first can begin with a null
    before = Window.orderBy(F.col("first.doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    files = stored(files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("files_ahead")))
    # the rows stay where they are: the table of files is as small as their number
    return rows.join(maybe_broadcast(files, files.count()), "file").withColumn("start", F.col("files_ahead") + F.col("ahead")).drop("file", "files_ahead")


def _crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["ids"]
        values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        at = lists.offsets.to_numpy()
        crcs = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["start"], batch["n_tokens"].cast(pa.int64()), pa.array(crcs, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows with a start."""
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")


def in_range(column: Column, low: int, high: int) -> Column:
    """Filter that ORC answers from its indexes: low <= column < high."""
    return (column >= low) & (column < high)
