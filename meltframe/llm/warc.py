"""WARC archives of web pages: written as monolithic gzip, normalised to one gzip member per record with an offset index, read back.

Writing is a plain text job: a record is one string (header, HTTP head, payload), the writer's line separator ends it, and the writer's
gzip codec makes each file a single stream, as many crawlers deliver them. The normaliser inflates such a file once from start to end,
compresses every record as a member of its own and writes beside each archive a sidecar index of offset and length per record, so that
one record can be read without the rest. Both kinds of file are committed by Spark's writer, so a lost executor leaves no halves; an
archive and its index come from one task and carry its number in their names.

Payloads are written by size class, each with a number of records per file that keeps a file under `ARCHIVE_BYTES` (a record of more than
the largest class is a file of its own), so no archive outgrows an executor, whatever the sizes of pages.

The text writer ends each row with a separator; here it is the zero byte that ends a gzip member anyway (the top byte of the length in
its trailer). A record of 16 MiB or more has another top byte: it is closed by an empty member, which gzip readers join to it.

Members pass through the writer as strings. It copies their bytes without looking at them; a test holds bytes that are no UTF-8 against
what is read back.

Of records with equal payloads (two digests and length) of at least `min_bytes` bytes, the one with the smallest page_id is a response and the
others are revisits that refer to it. Defined results: null html is an empty payload; a null url gives the record a urn; control
characters and blanks of a url are percent-encoded; rows with a null page_id are records, and are responses unless an equal payload has
an id; repeated rows with the smallest id are all responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltframe.llm.common import maybe_broadcast
from meltframe.session import stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes of payload an archive may hold, and the largest payload of each size class but the last.
ARCHIVE_BYTES = 256 << 20
CLASS_BYTES = (64 << 10, 1 << 20, 16 << 20)
# Bytes and rows of a batch that a task hands on.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 500
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
ARCHIVE, INDEX = 0, 1

MEMBER_SCHEMA = "kind int, seq bigint, value binary"
INDEX_SCHEMA = "offset bigint, length bigint, type string, id string, uri string"
RECORD_SCHEMA = ("archive bigint, offset bigint, length bigint, page_id bigint, uri string, record_type string, payload_digest string, "
                 "payload_bytes bigint, refers_to bigint, payload binary")


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string: five hex digits hold four characters."""
    parts = []
    for group in range(8):
        value = F.conv(F.substring(hexed, 1 + 5 * group, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def _payload_key(payload: Column) -> list[Column]:
    return [F.sha1(payload).alias("sha"), F.xxhash64(payload).alias("hash"), F.octet_length(payload).alias("bytes")]


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """sha, hash, bytes, first_id of every payload that occurs more than once."""
    seen = pages.select("page_id", *_payload_key(F.coalesce("html", F.lit("")))).where(F.col("bytes") >= min_bytes)
    groups = seen.groupBy("sha", "hash", "bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    return stored(groups.where("n > 1 and first_id is not null").select("sha", "hash", "bytes", "first_id"))


def size_class(html: Column) -> Column:
    size = F.coalesce(F.octet_length(html), F.lit(0))
    return sum(((size > limit).cast("int") for limit in CLASS_BYTES), F.lit(0))


def write_monolithic(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Whole-file gzip archives in `path`/class=N/: one per task, size class and number of records that fits."""
    first = revisits(pages, min_bytes)
    classes = sorted(r[0] for r in pages.select(size_class(F.col("html"))).distinct().collect()) or [0]
    for k in classes:
        records = max(1, ARCHIVE_BYTES // CLASS_BYTES[k]) if k < len(CLASS_BYTES) else 1
        rows = _records(pages.where(size_class(F.col("html")) == k), first)
        # the separator is the last character of the record's two empty lines
        rows.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{path}/class={k}")


def _records(pages: DataFrame, first: DataFrame) -> DataFrame:
    """One string per page, without the last line feed; `first` is the stored table of repeated payloads."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select("page_id", "url", "payload", *_payload_key(F.col("payload")))
    rows = rows.join(maybe_broadcast(first, first.count()), ["sha", "hash", "bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(END + END))
    # a revisit keeps the HTTP head, with the length of the payload it stands for, and drops the payload
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: <"), urn, F.lit(f">{END}WARC-Target-URI: "), F.coalesce(clean, urn),
        F.lit(f"{END}WARC-Date: 2000-01-01T00:00:00Z{END}WARC-Payload-Digest: sha1:"), base32(F.col("sha")),
        F.when(again, F.concat(F.lit(f"{END}WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"),
                               F.lit(f">{END}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "))
    return rows.select(F.concat(head, F.octet_length(block).cast("string"), F.lit(END + END), block, F.lit("\r\n\r")).alias("value"))


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The inflated stream of a gzip file piece by piece, over all its members."""
    view, at = memoryview(content), 0
    while at < len(view):
        if view[at] == 0:  # padding after a member
            at += 1
            continue
        stream = zlib.decompressobj(31)
        while not stream.eof:
            piece = view[at:at + step]
            if not len(piece):
                raise ValueError("the archive ends within a gzip member")
            out = stream.decompress(piece)
            at += len(piece) - len(stream.unused_data)
            if out:
                yield out


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and the bytes of each record of a WARC stream, in one pass over it."""
    held = bytearray()

    def need(size: int) -> bool:
        while len(held) < size:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not need(looked + 1):
                if held:
                    raise ValueError("the archive ends within a record's header")
                return
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        size = end + 4 + int(fields["content-length"]) + 4
        if not need(size):
            raise ValueError("the archive ends within a record")
        yield fields, bytes(held[:size])
        del held[:size]


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = packer.compress(record) + packer.flush()
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def batched(rows: Iterator[tuple], sizes: Callable[[tuple], int], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += sizes(row)
        if len(some) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)


def _normalise(batches: Iterator[pa.RecordBatch], level: int = 6) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        offset = seq = 0  # of the file this task writes, over all the files it reads
        for batch in batches:
            for content in batch["content"]:
                for fields, record in split_records(inflate(content.as_buffer())):
                    member = _member(record, level)
                    entry = {"offset": offset, "length": len(member), "type": fields.get("warc-type"),
                             "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri")}
                    yield ARCHIVE, seq, member[:-1]
                    yield INDEX, seq, json.dumps(entry).encode()
                    offset, seq = offset + len(member), seq + 1

    yield from batched(rows(), lambda r: len(r[2]), ["kind", "seq", "value"], [pa.int32(), pa.int64(), pa.binary()])


def normalise(spark: SparkSession, source: str, path: str) -> None:
    """Rewrite monolithic archives: a file of `path`/kind=0/ holds a member per record, the one of that number in `path`/kind=1/ its index (JSON)."""
    files = spark.read.format("binaryFile").load(source).select("content")
    rows = files.mapInArrow(_normalise, MEMBER_SCHEMA).withColumn("value", F.col("value").cast("string"))
    # the writer keeps this order, so offsets hold; both kinds leave one pass over the archive
    ordered = rows.sortWithinPartitions("kind", "seq").select("kind", "value")
    ordered.write.partitionBy("kind").option("lineSep", "\u0000").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _archive(path: Column) -> Column:
    """An archive's number: that of the task which wrote it."""
    return F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("bigint")


def members(content: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and inflated bytes of every record of a normalised archive; an empty member belongs to the one before it."""
    view, at, held = memoryview(content), 0, None
    while at < len(view):
        stream, start, parts = zlib.decompressobj(31), at, []
        while not stream.eof:
            piece = view[at:at + step]
            if not len(piece):
                raise ValueError("the archive ends within a gzip member")
            parts.append(stream.decompress(piece))
            at += len(piece) - len(stream.unused_data)
        data = b"".join(parts)
        if data:
            if held:
                yield held
            held = (start, at - start, data)
        elif held:
            held = (held[0], at - held[0], held[2])
    if held:
        yield held


def parse(data: bytes) -> tuple:
    """What a record says, in the order of RECORD_SCHEMA; a response's payload is held against its digest."""
    (fields, record), = split_records(iter([data]))
    block = record[-4 - int(fields["content-length"]):-4]
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if revisit:
        size = int(re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M).group(1))
    else:
        size = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")

    def number(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found.group(1)) if found else None

    return (number("warc-record-id"), fields["warc-target-uri"], fields["warc-type"], digest, size, number("warc-refers-to"),
            None if revisit else payload)


def _read(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "offset", "length", "page_id", "uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        types = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64()] * 2 + [pa.binary()]

        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
            for i, (archive, content) in enumerate(zip(batch["archive"].to_pylist(), batch["content"])):
                content = content.as_buffer()
                if "entries" in batch.schema.names:
                    spans = [(e["offset"].as_py(), e["length"].as_py()) for e in batch["entries"][i]]
                    found = ((at, size, b"".join(inflate(memoryview(content)[at:at + size]))) for at, size in spans)
                else:
                    found = members(content)
                for at, size, data in found:
                    row = parse(data)
                    yield (archive, at, size, *(row if payloads else (*row[:-1], None)))

        for batch in batches:
            yield from batched(rows_of(batch), lambda r: len(r[-1] or b""), names, types)
    return read


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, length, type, id, uri of every record."""
    if not _exists(spark, f"{path}/kind={INDEX}"):  # no record at all
        return spark.createDataFrame([], f"archive bigint, {INDEX_SCHEMA}")
    rows = spark.read.option("lineSep", "\u0000").schema(INDEX_SCHEMA).json(f"{path}/kind={INDEX}")
    return rows.select(_archive(F.col("_metadata.file_path")).alias("archive"), "*")


def read_archive(spark: SparkSession, path: str, wanted: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of the archives, with the place of each.

    Without `wanted` every archive is read from start to end, member by member, where it lies. With `wanted` (rows of `read_index`)
    only those archives are opened, and in them only the members the index points to are inflated.
    """
    if not _exists(spark, f"{path}/kind={ARCHIVE}"):
        return spark.createDataFrame([], RECORD_SCHEMA)
    files = spark.read.format("binaryFile").load(f"{path}/kind={ARCHIVE}").select(_archive(F.col("path")).alias("archive"), "content")
    if wanted is not None:
        spans = wanted.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("entries"))
        files = files.join(spans, "archive")
    return files.mapInArrow(_read(payloads), RECORD_SCHEMA)
