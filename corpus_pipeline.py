"""A training-data pipeline: toxic documents and poor ones go, one of each near-duplicate group stays, sources are mixed, texts are encoded.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of ``documents``; further
columns come along, whatever their names. Nulls, empty and long texts, repeated rows and empty tables are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rateweave.llm import bpe, minhash, mixing, quality, toxicity
from rateweave.llm.catalog import VOCABULARY
from rateweave.llm.common import table
from rateweave.session import materialize


def aside(docs: DataFrame, outputs: list[tuple]) -> DataFrame:
    """``docs`` with columns that have the name of an operator's output renamed, so that they survive it."""
    taken = {name for name, *_ in outputs} | {"rejected"}
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c.lower() in taken})


def back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return df.select(*(F.col(f"_own_{c}" if f"_own_{c}" in df.columns else c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the limit. Labels without a document in ``docs`` teach nothing."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return back(toxicity.rated(aside(docs, toxicity.FIELDS), labels).where(~F.col("rejected")), docs)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that failed."""
    cleaned = quality.clean(aside(docs, quality.FIELDS)).where("kept").withColumn("text", F.col("clean_text"))
    return back(cleaned.withColumn("n_chars", F.length("text").cast("long")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity of 0.8): that with the smallest id.

    Rows that repeat an id and a text are one document: the row whose other columns come first, written as JSON, stays. Different texts under
    one id are documents of their own, by the order of their md5.
    """
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(mixing.text_key(F.col("text"))).alias("low"), F.max(mixing.text_key(F.col("text"))).alias("high"))
    rows = docs.groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), _written(docs)).alias("row")).select("row.*")
    if texts.where("low < high").isEmpty():
        gone = minhash.classes(docs, percent=80).where("not kept").select("doc_id").distinct()
        return rows.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # numbers in the order of ids and texts take the place of ids
    order = ("doc_id", mixing.text_key(F.col("text")))
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_number", number), "numbered")
    gone = minhash.classes(rows, percent=80, doc_id="_number").where("not kept").select(F.col("doc_id").alias("_number"))
    return rows.join(gone, "_number", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order of blocks; a document is repeated as often as it is passed, none is left out.

    Partitions are ranges of (block, place), each sorted. Identical rows are as many documents, each with passes of its own.
    """
    mixed = mixing.mix(docs, entropy_share=0.95, max_repeats=2.0)
    mixed = mixed.select(
        _identity("doc_id", "source", F.col("text_key")), F.col("pass").alias("_pass"), F.col("block").alias("_block"), F.col("place").alias("_place")
    )
    mixed = mixed.withColumn("_copy", F.row_number().over(Window.partitionBy("_key", "_pass").orderBy("_block", "_place")))
    own = docs.withColumn("_key", _identity("doc_id", "source", mixing.text_key(F.col("text"))))
    own = own.withColumn("_copy", F.row_number().over(Window.partitionBy("_key").orderBy(_written(docs))))
    placed = own.join(mixed, ["_key", "_copy"]).repartitionByRange("_block", "_place").sortWithinPartitions("_block", "_place", "_copy")
    return placed.select(*docs.columns)


def _written(docs: DataFrame) -> Column:
    """The columns besides id and text as JSON: an order among rows that repeat these."""
    return F.to_json(F.struct(F.lit(0).alias("_"), *(c for c in docs.columns if c not in ("doc_id", "text"))), {"ignoreNullFields": "false"})


def _identity(doc_id: str, source: str, text_key: Column) -> Column:
    """What the mix knows a document by; nulls are left out of the JSON, so that they equal no text."""
    key = F.struct(F.col(doc_id).cast("long").alias("i"), F.col(source).cast("string").alias("s"), text_key.alias("t"))
    return F.md5(F.to_json(key).cast("binary")).alias("_key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids (packed unsigned 32-bit integers)."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), bpe.vocabulary(spark, VOCABULARY))
    return coded.select("doc_id", "source", F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode),
]

#: The fitted model and MinHash are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
