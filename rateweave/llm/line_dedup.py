"""Lines that many documents share stay in one of them; two Bloom filters pick what has to be compared.

1. Filters. Every task hashes the keys of its documents' lines, each key once a document, to ``PROBES`` bits. Bits seen once go to
   the first filter, bits seen again to the second; tasks send only the bits that they set, by segments of ``SEGMENT_BITS``,
   and the tasks of a segment are merged one after another. A bit that two tasks have seen once has been seen twice.
2. Suspects. A line is suspected if all its bits are in the second filter. A key that two documents hold always is; a key that only one holds is
   by chance, the more often the fuller the filter. Only suspected lines move, as (document, SHA-256 of the key).
3. Confirmation. Suspects are counted exactly: distinct documents per key, and the largest of them. Keys are salted by document, so that the
   documents of a very common line are dealt over ``SALTS`` groups.
4. Removal. Documents without suspects are done where they were read. The others meet the list of keys that they lose.

The second filter is the only thing broadcast. Its size, ``filter_bits`` / 8 bytes, is a parameter and doesn't depend on the data. Where the data
outgrow it, more lines are suspected and move as rows of 40 bytes, at worst all; results are the same.

Defined results: a null text counts as an empty one, which is one empty line. Keys are compared by SHA-256. Documents are told apart by
id: rows that repeat an id count once, and each of them keeps its lines if that id is the largest. Rows without id take no part in
counting and lose nothing. Very long texts and lines are taken whole. An empty table gives an empty result. Further columns come along; those named
like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from rateweave.llm.common import slices, with_python_columns
from rateweave.session import materialize

LEAST_POINTS = 20
LEAST_DOCUMENTS = 3
FILTER_BITS = 1 << 26
SEGMENT_BITS = 1 << 16
PROBES = 2
SALTS = 256
#: Bits that a task gathers before it sends them; bounds its memory.
GATHERED = 1 << 22
BLANKS = b" \t\n\x0b\x0c\r"
OUTPUTS = ("n_lines", "n_dropped", "kept_text")


def keys(text: str | None, least_points: int = LEAST_POINTS) -> list[bytes | None]:
    """The key of each line, None for keys that are too short."""
    out = []
    for line in (text or "").encode("utf-8").lower().split(b"\n"):  # bytes: only A-Z change
        key = line.strip(BLANKS)
        long = len(key) >= least_points and (key.isascii() or len(key.decode("utf-8")) >= least_points)
        out.append(key if long else None)
    return out


def bits_of(found: list[bytes], filter_bits: int) -> np.ndarray:
    """The places of each key's bits in the filters, a row per key."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)
    return (hashes[:, None] + probes[None, :] * step[:, None]) & np.uint64(filter_bits - 1)


def set_bits(docs: DataFrame, filter_bits: int, least_points: int) -> DataFrame:
    """(segment, once, twice): the places within a segment that a task has seen at all, and again."""

    def sent(places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not places:
            return
        at, seen = np.unique(np.concatenate(places), return_counts=True)
        segment = (at // SEGMENT_BITS).astype(np.int32)
        low = (at % SEGMENT_BITS).astype(np.uint16)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        ends = np.append(starts[1:], len(at))
        again = seen > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(segment[starts]),
             pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
             pa.array([low[a:b][again[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary())],
            names=["segment", "once", "twice"],
        )

    def run(batches):
        held, n = [], 0
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                found = list({k for k in keys(text, least_points) if k is not None})
                if found:
                    held.append(bits_of(found, filter_bits).ravel())
                    n += len(held[-1])
                if n >= GATHERED:
                    yield from sent(held)
                    held, n = [], 0
        yield from sent(held)

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "segment int, once binary, twice binary")


def merged(parts: DataFrame) -> DataFrame:
    """(segment, once, twice) with the whole filters of each segment, packed. A segment's parts pass through one by one."""

    def run(batches):
        key, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int32()), *(pa.array([np.packbits(x).tobytes()], pa.binary()) for x in (once, twice))],
                names=["segment", "once", "twice"],
            )

        for batch in batches:
            for segment, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != key:
                    if key is not None:
                        yield done()
                    key, once, twice = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                at = np.frombuffer(a, np.uint16)
                twice[at[once[at]]] = True
                twice[np.frombuffer(b, np.uint16)] = True
                once[at] = True
        if key is not None:
            yield done()

    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, once binary, twice binary")


def seen_twice(docs: DataFrame, filter_bits: int = FILTER_BITS, least_points: int = LEAST_POINTS) -> bytes:
    """The second filter: ``filter_bits`` / 8 bytes, whatever the data."""
    if filter_bits < SEGMENT_BITS or filter_bits & (filter_bits - 1):
        raise ValueError(f"filter_bits must be a power of two, {SEGMENT_BITS} at least")
    whole = np.zeros((filter_bits // SEGMENT_BITS, SEGMENT_BITS // 8), np.uint8)
    for row in merged(set_bits(docs, filter_bits, least_points)).select("segment", "twice").collect():
        whole[row.segment] = np.frombuffer(row.twice, np.uint8)
    return whole.tobytes()


def with_suspects(docs: DataFrame, twice, filter_bits: int, least_points: int) -> DataFrame:
    """``docs`` with ``suspects``: the digests of a text's keys whose bits are all in the second filter, each once."""

    def make(part: pa.RecordBatch) -> list[list]:
        bits = np.frombuffer(twice.value, np.uint8)
        out = []
        for text in part.column("text").to_pylist():
            found = list({k for k in keys(text, least_points) if k is not None})
            if not found:
                out.append([])
                continue
            at = bits_of(found, filter_bits).astype(np.int64)
            hit = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            out.append([hashlib.sha256(found[i]).digest() for i in np.flatnonzero(hit)])
        return [out]

    return with_python_columns(docs, [("suspects", T.ArrayType(T.BinaryType()), pa.list_(pa.binary()))], make)


def losses(suspects: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, lost): the keys that each document loses. ``suspects`` has distinct (doc_id, key)."""
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("key", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    common = parts.groupBy("key").agg(
        F.sum("n").alias("n"), F.max("last").alias("last"), F.collect_list("salt").alias("salts")  # SALTS at most
    ).where(F.col("n") >= least_documents)
    told = common.select("key", "last", F.explode("salts").alias("salt"))
    lost = salted.join(told, ["key", "salt"]).where("doc_id != last")
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("lost"))


def dedup(
    docs: DataFrame, least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_lines, n_dropped and kept_text."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", *OUTPUTS)]
    own = docs.select("doc_id", "text", F.struct(*others).alias("others") if others else F.lit(None).cast("string").alias("others"))
    twice = spark.sparkContext.broadcast(seen_twice(own, filter_bits, least_points))
    listed = with_suspects(own.where("doc_id is not null").select("doc_id", "text"), twice, filter_bits, least_points)
    suspects = materialize(listed.select("doc_id", F.explode("suspects").alias("key")).distinct(), "suspects")
    lost = materialize(losses(suspects, least_documents), "losses")

    marked = with_suspects(own, twice, filter_bits, least_points)
    touched = (F.size("suspects") > 0) & F.col("doc_id").isNotNull()
    text = F.coalesce("text", F.lit(""))
    as_is = marked.where(~touched).select(
        "doc_id", "text", "others", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dropped"), text.alias("kept_text"),
    )
    cut = removed(marked.where(touched).drop("suspects").join(lost, "doc_id", "left"), least_points)
    every = as_is.unionByName(cut)
    return every.select("doc_id", "text", *(F.col(f"others.`{c}`").alias(c) for c in others), *OUTPUTS)


def removed(docs: DataFrame, least_points: int) -> DataFrame:
    """``docs`` without the lines whose keys are in ``lost``."""

    def make(part: pa.RecordBatch) -> list[list]:
        counts, dropped, kept = [], [], []
        for text, lost in zip(part.column("text").to_pylist(), part.column("lost").to_pylist()):
            lines = (text or "").split("\n")
            stay = lines
            if lost:
                gone = set(lost)
                stay = [
                    line for line, key in zip(lines, keys(text, least_points))
                    if key is None or hashlib.sha256(key).digest() not in gone
                ]
            counts.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        return [counts, dropped, kept]

    fields = [(n, T.LongType(), pa.int64()) for n in OUTPUTS[:2]] + [(OUTPUTS[2], T.StringType(), pa.string())]
    return with_python_columns(docs, fields, make).drop("lost")
