"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rateweave.llm import (
    ann, bpe, licences, line_dedup, merkle, minhash, mixing, oracles, quality, ranked_search, token_files, toxicity, url_filter, warc,
)
from rateweave.llm.common import table
from rateweave.session import materialize

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and decoded text."""
    vocabulary = bpe.vocabulary(spark, VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, vocabulary).select("doc_id", "token_ids"), vocabulary)
    return coded.select(
        "doc_id", F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, links at 85 of 100."""
    return minhash.classes(table(spark, sf_dir, "documents"), percent=85)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to seekable files and read them back."""
    vocabulary = bpe.vocabulary(spark, VOCABULARY)
    manifest = token_files.write(
        table(spark, sf_dir, "documents"), lambda texts: vocabulary().encode_all(texts), END_ID, vocabulary.size
    )
    return token_files.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix the sources of the documents: at most 0.95 of the greatest entropy, at most two repeats, nothing left out."""
    return mixing.mix(table(spark, sf_dir, "documents"), entropy_share=0.95, max_repeats=2.0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, index the captures, look every page up in the index, and read its record."""
    pages = table(spark, sf_dir, "pages")
    directory = warc.write_index(warc.write(pages))
    records = warc.records(warc.find(directory, pages)).select(
        "page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1")
    )
    records = materialize(records, "records")
    # a revisit has the payload of the response it names
    full = records.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "digest", F.col("n").alias("full_n"), F.col("sha1").alias("full_sha1")
    ).distinct()
    own = F.col("record_type") == "response"
    return records.join(full, ["refers_to", "digest"], "left").select(
        "page_id", F.when(own, F.col("n")).otherwise(F.col("full_n")).alias("payload_bytes"),
        F.when(own, F.col("sha1")).otherwise(F.col("full_sha1")).alias("payload_digest"), "record_type", "refers_to",
    )


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build_index(vectors), vectors.where("vec_id % 100 = 0"), k=10)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents, also wrapped ones and those within longer lines."""
    return licences.notices(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the line-first rules on all documents."""
    return quality.clean(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, by a model fitted on the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.rated(docs, labels).drop("text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item, among all documents."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that they share with others."""
    cut = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, and whether it holds for what is left of the document after some have lost their line ends."""
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    cut = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.verified(table(spark, sf_dir, "documents"), merkle.leaf_digest(text=cut))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    named = (
        op1_bpe, op2_minhash, op3_token_files, op4_mix, op5_warc, op6_ann, op7_url_filter, op8_licences, op9_quality, op10_toxicity,
        op11_ranked_search, op12_line_dedup, op13_merkle,
    )
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
