"""The registered queries of the training-data operators: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltframe.llm import chat, exact_dedup, language, merkle, mixing, near_dedup, neighbours, packing, sentencepieces, token_files, toxicity, warc, whitening
from meltframe.llm.common import ascii_lower, table
from meltframe.llm.oracle import ORACLE_SQL  # noqa: F401 - read from here by the entry
from meltframe.session import shared_path, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_toxicity(spark, d):
    """A toxicity score of every document, learned from the labels of those that are not held out."""
    docs = table(spark, d, "documents")
    model = toxicity.train(docs, table(spark, d, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_minhash_near_dedup(spark, d):
    """All documents with their group of near copies: four-word shingles, similarity 0.8."""
    return near_dedup.near_groups(table(spark, d, "documents"), percent=80, words=4)


@query
def op3_sentencepiece(spark, d):
    """Every document encoded with the public BPE vocabulary and decoded again."""
    return sentencepieces.digests(table(spark, d, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op4_warc(spark, d):
    """Every page written to monolithic archives, normalised to a member per record, and read back; each record must be in the offset index."""
    whole, members = shared_path(spark, "warc"), shared_path(spark, "warc")
    warc.write_monolithic(table(spark, d, "pages"), whole)
    warc.normalise(spark, whole, members)
    place = ["archive", "offset", "length"]
    records = warc.read_archive(spark, members, payloads=False).join(warc.read_index(spark, members).select(*place), place)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_chat_format(spark, d):
    """All conversations and one more that speaks in control strings, formatted and read back from the formatted output."""
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = chat.read_chat(chat.format_chat(turns))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
        "valid", "bad_turn")


@query
def op6_token_files(spark, d):
    """Every document encoded, written to ORC files in doc_id order, and read back from them."""
    path = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark, d, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_files.digests(token_files.with_start(token_files.read_tokens(spark, path)))


@query
def op7_language_id(spark, d):
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, d, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = language.identify(docs, language.training_sample(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_source_mix(spark, d):
    """All documents mixed to 150 % of their words, sources weighing 5, 2, 1 in turn."""
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


@query
def op9_exact_dedup(spark, d):
    """All documents with the row that stays of each group of equal texts."""
    return exact_dedup.find_copies(table(spark, d, "documents"))


@query
def op10_nearest_vectors(spark, d):
    """The ten nearest vectors of every hundredth vector, among all."""
    return neighbours.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op13_merkle_manifest(spark, d):
    """All documents with their proofs, and what the proofs say of those whose text was lower-cased."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(table(spark, d, "documents"), altered=F.when(tampered, ascii_lower(F.col("text"))))
    return merkle.digests(found)


@query
def op11_best_fit_packing(spark, d):
    """Every document tokenised and packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, d, "documents"), tokenizer("word_bpe_49k.json"), end_id=0, capacity=2_048)


@query
def op12_embedding_whitening(spark, d):
    """Every vector whitened along the 16 components of largest variance."""
    return whitening.whiten(table(spark, d, "embeddings"), most=16)
