"""Near-duplicate groups by HyperMinHash: compressed registers, banding, corrected estimates, and links confirmed on full sets.

1. Every text becomes a set of word shingles; equal sets are one class, named by its least doc_id, so copies cost one row each.
2. A class has 256 registers (leading-zero count and mantissa bits) cut into 51 bands of five; two classes of similarity 0.8 miss each
   other in all bands with probability 2e-9.
3. In each bucket that several classes share, all are compared with the least one. Links found are contracted to components.
4. Buckets of more than two that still hold several components are finished: their members outside the bucket's largest component are
   compared with all others of another component, in blocks that hold the full sets. A pair is looked at in the first bucket both share.
   A block decides its pairs itself and emits the links of a spanning forest, fewer than it has rows; unlinked pairs leave no row behind.
A comparison estimates the similarity from the registers, corrected for accidental agreement, and drops the pair only six standard
deviations below the threshold; the rest is decided on the full sets. Pairs inside one component need no comparison: they cannot change
the result. No bucket is cut off, and none is in one task: anchors come from a grouping, blocks have a bounded number of rows and items.

Defined results: null texts and texts without words have an empty set and are linked with nothing; rows that repeat a doc_id with other
texts are one document in all links; rows with a null doc_id take no part and are their own group (null); an empty table gives an empty
table; other columns are ignored by `near_groups` and carried by `drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meltframe.llm import shingles as S
from meltframe.llm.common import maybe_broadcast, per_worker, tidy
from meltframe.llm.components import components
from meltframe.session import free, stored

BAND_ROWS = 5
# Rows of a block and items of all their sets, about.
BLOCK, BLOCK_ITEMS = 1_024, 2_000_000
SEEDS = (0x5EED, 0xF00D)
# Standard deviations below the threshold at which an estimate drops a pair.
DEVIATIONS = 6
TEXTS_AT_ONCE = 256


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _shingler(words: int) -> S.Shingler:
    return per_worker(("shingler", words), lambda: S.Shingler(words))


def _digest(items: np.ndarray, seed: int) -> int:
    return int(S.mixed(items ^ np.uint64(seed)).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, words: int = S.WORDS) -> DataFrame:
    """doc_id, n_shingles, two 64-bit digests of the set, signature (its registers)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(words)
        for batch in _slices(batches, TEXTS_AT_ONCE):
            rows = []
            for items in shingler.sets(batch["text"]):
                # sums of independently mixed items: equal for equal sets, in any order
                digests = [_digest(items, seed) for seed in SEEDS]
                rows.append((len(items), *digests, S.registers(items).tobytes()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, t) for c, t in zip(zip(*rows), types)]],
                                             ["doc_id", "n_shingles", "digest1", "digest2", "signature"])
        tidy()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, digest1 long, digest2 long, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column, one per line."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), S.REGISTERS)


def bands(classes: DataFrame) -> DataFrame:
    """(band, cid): a row per class and band."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2_048):
            keys = S.band_keys(_matrix(batch["signature"]), BAND_ROWS)
            yield pa.RecordBatch.from_arrays([batch["cid"], pa.array(list(keys), pa.list_(pa.int64()))], ["cid", "bands"])

    cut_up = classes.select("cid", "signature").mapInArrow(cut, "cid long, bands array<long>")
    return cut_up.select(F.explode("bands").alias("band"), "cid")


def _floor(similarity: float) -> float:
    return similarity - DEVIATIONS * (similarity * (1 - similarity) / S.REGISTERS) ** 0.5


def _promising(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose estimate does not rule them out."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2_048):
            near = S.estimate(_matrix(batch["sa"]), _matrix(batch["sb"]), batch["na"].to_numpy(), batch["nb"].to_numpy()) >= _floor(similarity)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    left = classes.select(F.col("cid").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    right = classes.select(F.col("cid").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    # sizes alone rule out a pair whose larger set is too large
    sized = pairs.join(right, "b").join(left, "a").where(F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-6)
    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(words)
        last_text, last_set = None, None
        for batch in _slices(batches, 256):
            keep = []
            texts_a = batch["ta"].to_pylist()
            for text, b in zip(texts_a, shingler.sets(batch["tb"])):
                if text != last_text or last_set is None:  # rows of one a follow each other
                    last_text, last_set = text, next(shingler.sets(pa.array([text])))
                common = len(np.intersect1d(last_set, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(last_set) + len(b) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    # only texts that occur in a pair are moved
    pairs = stored(pairs)
    used = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(maybe_broadcast(used, 2 * pairs.count()), "doc_id", "left_semi")
    texts = stored(texts)
    joined = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    links = stored(joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").distinct())
    free(pairs, texts)
    return links


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cid, digest1, items (the whole set, sorted 64-bit hashes) of every text whose doc_id is a `cid` of the stored table `wanted`."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(words)
        for batch in _slices(batches, 256):
            sets = list(shingler.sets(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([_digest(x, SEEDS[0]) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["cid", "digest1", "items"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        maybe_broadcast(wanted.select(F.col("cid").alias("doc_id")), wanted.count()), "doc_id", "left_semi")
    return stored(texts.mapInArrow(collect, "cid long, digest1 long, items binary").groupBy("cid", "digest1").agg(F.any_value("items").alias("items")))


def _finish(crowded: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) that join the components which buckets still hold apart, at most one fewer than rows in every block.

    Buckets of two are done: their one pair was compared before. A block holds whole sets, so pairs are decided where they meet, and a
    pair is looked at only in the first bucket that both share, and only while the two are in different components of the block.
    """
    now = crowded.join(labels, crowded["cid"] == labels["node"], "left").select(
        "band", "cid", F.coalesce("component", "cid").alias("component"))
    sized = now.join(classes.select("cid", "n_shingles"), "cid")
    per_component = sized.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items"))
    per_band = per_component.groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n"),
        F.sum("items").alias("items"))
    per_band = per_band.where("n > most and n > 2")
    whole_blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS))
    stray_blocks = F.greatest(F.ceil((F.col("n") - F.col("most")) / BLOCK), F.ceil(F.col("items") * (1 - F.col("most") / F.col("n")) / BLOCK_ITEMS))
    open_bands = stored(per_band.select("band", "largest", stray_blocks.cast("int").alias("strays"), whole_blocks.cast("int").alias("alls")))
    members = stored(now.join(maybe_broadcast(open_bands, open_bands.count(), 200_000), "band"))
    wanted = stored(members.select("cid").distinct())
    whole = _sets(docs, wanted, words)
    # one row per distinct text that is still in question, with all that a block needs of it
    texts = stored(classes.join(whole, ["cid", "digest1"]))
    rows = members.join(texts, "cid").withColumn("at", F.pmod(F.xxhash64("cid"), F.lit(1 << 20)).cast("int"))

    def blocks(upto: str):
        return F.sequence(F.lit(0), F.col(upto) - 1)

    columns = ["band", "x", "y", "left", "cid", "component", "n_shingles", "signature", "items"]
    strays = rows.where("component <> largest").withColumn("x", F.col("at") % F.col("strays")).withColumn(
        "y", F.explode(blocks("alls"))).withColumn("left", F.lit(True)).select(columns)
    everyone = rows.withColumn("y", F.col("at") % F.col("alls")).withColumn(
        "x", F.explode(blocks("strays"))).withColumn("left", F.lit(False)).select(columns)
    similarity = percent / 100
    floor = _floor(similarity)

    def compare(table: pa.Table) -> pa.Table:
        left = table.filter(table["left"]).combine_chunks()
        right = table.filter(pa.compute.invert(table["left"])).combine_chunks()
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            a, b = left["cid"].to_numpy(), right["cid"].to_numpy()
            na, nb = left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy()
            sa, sb = _matrix(left["signature"].combine_chunks()), _matrix(right["signature"].combine_chunks())
            ka, kb = S.band_keys(sa, BAND_ROWS), S.band_keys(sb, BAND_ROWS)
            band = table["band"][0].as_py()
            _, label = np.unique(np.concatenate([left["component"].to_numpy(), right["component"].to_numpy()]), return_inverse=True)
            la, lb = label[:len(a)].copy(), label[len(a):].copy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in right["items"].combine_chunks()]
            for i, mine in enumerate(left["items"].combine_chunks()):
                place = np.flatnonzero(ka[i] == band)
                if not len(place):
                    continue
                place = int(place[0])
                may = np.flatnonzero((lb != la[i]) & (kb[:, place] == band) & (np.minimum(nb, na[i]) >= np.maximum(nb, na[i]) * similarity - 1e-6))
                may = may[~(kb[may, :place] == ka[i, :place]).any(axis=1)]
                if not len(may):
                    continue
                close = S.estimate(np.broadcast_to(sa[i], (len(may), S.REGISTERS)), sb[may], np.full(len(may), na[i]), nb[may])
                may = may[close >= floor]
                mine = np.frombuffer(mine.as_buffer(), np.uint64)
                for some in np.array_split(may, -(-len(may) // 256)) if len(may) else ():
                    items = np.concatenate([sets[j] for j in some])
                    starts = np.cumsum(nb[some]) - nb[some]
                    spot = np.minimum(np.searchsorted(mine, items), len(mine) - 1)
                    common = np.add.reduceat((mine[spot] == items).astype(np.int64), starts)
                    for j in some[100 * common >= percent * (na[i] + nb[some] - common)]:
                        if lb[j] != la[i]:
                            out.append((int(a[i]), int(b[j])))
                            old = lb[j]
                            lb[lb == old] = la[i]
                            la[la == old] = la[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    links = stored(strays.unionByName(everyone).groupBy("band", "x", "y").applyInArrow(compare, "a long, b long").distinct())
    free(open_bands, members, wanted, whole, texts)
    return links


def near_groups(docs: DataFrame, percent: int = 80, words: int = S.WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept."""
    similarity = percent / 100
    signed = stored(signatures(docs, words))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(usable.groupBy("n_shingles", "digest1", "digest2").agg(
        F.min("doc_id").alias("cid"), F.any_value("signature").alias("signature")))
    signature = classes.select("cid", "n_shingles", "signature")
    spread = stored(bands(signature))
    shared = spread.groupBy("band").agg(F.min("cid").alias("anchor"), F.count("*").alias("n")).where("n > 1").select("band", "anchor")
    crowded = stored(spread.join(shared, "band"))
    pairs = stored(crowded.where("cid <> anchor").select(F.col("anchor").alias("a"), F.col("cid").alias("b")).distinct())
    links = _confirmed(_promising(pairs, signature, similarity), docs, percent, words)
    labels = stored(components(links))
    more = _finish(crowded, labels, classes.select("cid", "digest1", "n_shingles", "signature"), docs, percent, words)
    if not more.isEmpty():
        labels = stored(components(links.unionByName(more)))
    free(spread, crowded, pairs)
    named = classes.select("n_shingles", "digest1", "digest2", "cid").join(labels, classes["cid"] == labels["node"], "left").select(
        F.col("n_shingles").alias("n"), F.col("digest1").alias("d1"), F.col("digest2").alias("d2"), F.coalesce("component", "cid").alias("component"))
    match = (signed["n_shingles"] == named["n"]) & (signed["digest1"] == named["d1"]) & (signed["digest2"] == named["d2"])
    found = signed.select("doc_id", "n_shingles", "digest1", "digest2").join(named, match, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of `docs` that stay, one document of each group, with all their columns.

    Of rows that repeat a doc_id the one with the smallest text stays (null before any text, then by a digest of all columns); rows
    with a null doc_id all stay.
    """
    groups = stored(near_groups(docs, percent, words).select("doc_id", "kept"))
    names = iter(f"meltframe_{i}" for i in range(len(docs.columns) + 8))
    gone_id, place = (next(n for n in names if n not in docs.columns) for _ in range(2))
    gone = stored(groups.where("not kept").select(F.col("doc_id").alias(gone_id)).distinct())
    kept = docs.join(maybe_broadcast(gone, gone.count()), F.col("doc_id").cast("bigint") == F.col(gone_id), "left_anti")
    again = stored(groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(gone_id)))
    if again.isEmpty():
        return kept
    repeated = F.col("doc_id").cast("bigint") == F.col(gone_id)
    once = kept.join(maybe_broadcast(again, again.count()), repeated, "left_anti")
    twice = kept.join(maybe_broadcast(again, again.count()), repeated, "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), *[F.xxhash64(c) for c in docs.columns if c != "text"])
    return once.unionByName(twice.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place))
