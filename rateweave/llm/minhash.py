"""Near-duplicate documents by one-permutation MinHash, confirmed on full shingle sets.

1. Signature. A document's distinct shingles are hashed once to 64 bits and dealt over ``BINS`` bins;
   each bin keeps its smallest hash. An empty bin borrows from a bin that a hash of its own number and of
   the attempt picks, attempt by attempt until that one isn't empty (optimal densification).
   ``ROWS`` bins make a band. Two sets with similarity s share a given band with probability s**ROWS: at
   0.85 all 40 bands miss with probability 6e-9, at 0.8 with 6e-6.
2. Equal sets. Documents with equal sets are linked to the smallest id among them, by a plain aggregate,
   however many there are. Only these representatives go on.
3. Star edges. Among the representatives that share a band's bucket, only pairs with the bucket's hub become
   candidates, so that a bucket of n gives n - 1 pairs. They are confirmed on their full sets, and the confirmed
   ones joined to classes.
4. Rest. The star loses a link between two members that are both unlike the hub. So in buckets whose members are not
   all in one class afterwards, members of different classes are compared by profiles, in blocks of about ``BLOCK_ROWS``; those of
   a bucket's largest class only meet the others. A profile has a byte of checksum for the hashes of each bin. Bins that differ hold at least one hash that is in one
   set only, and similar sets have few such hashes; pairs with more differing bins than that allows are out for certain. Only
   the pairs that are left become rows, and are confirmed on their full sets. So every pair that shares a bucket is linked through others,
   ruled out, or confirmed.

Sets so small that no other set can be similar enough have no bands.

Defined results: a null or empty text or one without words has an empty set, is linked with nothing and is a class
of its own. A row without id takes no part: its class is null and it is kept. Rows are documents: the
same id on several rows with equal texts is one class, and all of these rows carry ``kept``. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rateweave.llm.common import slices
from rateweave.llm.graph import components
from rateweave.session import materialize

WORDS = 5
ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
BLOCK_ROWS = 256

_rng = np.random.default_rng(20240229)
WORD_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROW_FACTORS = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALTS = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the word sequences of a text; A-Z count as a-z."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII blanks divide
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    total = np.zeros(len(found) - width + 1, np.uint64)
    for k in range(width):
        total += mixed(hashes[k : k + len(total)] * WORD_FACTORS[k])
    return np.unique(mixed(total + np.uint64(width)))


@functools.cache
def attempts(first: int, last: int) -> np.ndarray:
    """The bins that each bin tries in turn, from one attempt to another."""
    bins, tries = np.arange(BINS, dtype=np.uint64)[:, None], np.arange(first, last, dtype=np.uint64)[None, :]
    return (mixed((bins << np.uint64(32)) + tries + np.uint64(1)) % np.uint64(BINS)).astype(np.int32)


def bin_starts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins that have hashes, and where in the sorted hashes each begins."""
    bins = (((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bins, prepend=-1))
    return bins[starts], starts


def profile(hashes: np.ndarray) -> bytes:
    """A byte for each bin, equal for bins with equal hashes."""
    bins, starts = bin_starts(hashes)
    out = np.zeros(BINS, np.uint8)
    out[bins] = np.add.reduceat(mixed(hashes), starts).astype(np.uint8)
    return out.tobytes()


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; empty bins borrow."""
    bins, starts = bin_starts(hashes)
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins] = hashes[starts]
    full[bins] = True
    empty, at, step = np.flatnonzero(~full), 0, 8
    while len(empty):
        tried = attempts(at, at + step)[empty]
        hit = full[tried]
        first = hit.argmax(axis=1)
        found = hit[np.arange(len(empty)), first]
        out[empty[found]] = out[tried[found, first[found]]]
        empty, at, step = empty[~found], at + step, step * 2
    return out


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each band, as signed 64-bit numbers."""
    rows = mixed(signature(hashes).reshape(BANDS, ROWS) * ROW_FACTORS).sum(axis=1, dtype=np.uint64)
    return mixed(rows + BAND_SALTS).view(np.int64)


def signatures(docs: DataFrame, percent: int, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), bands and profile of each document."""

    def run(batches):
        for part in slices(batches):
            sizes, keys, buckets, profiles = [], [], [], []
            for body in part.column(1).to_pylist():
                hashes = shingle_set(body, words)
                n = len(hashes)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if n else None)
                # the most similar other set has one shingle more
                some = n and 100 * n >= percent * (n + 1)
                buckets.append(bands(hashes) if some else None)
                profiles.append(profile(hashes) if some else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(buckets, pa.list_(pa.int64())),
                 pa.array(profiles, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "bands", "profile"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, bands array<long>, profile binary"
    )


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and the full set of each document."""

    def run(batches):
        for part in slices(batches):
            sets = [shingle_set(body, words).view(np.int64) for body in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
        .where(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared))
        .select("a", "b")
    )


def classes(docs: DataFrame, percent: int = 80, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Documents are linked if 100 * shared shingles >= ``percent`` * shingles of either; a component is what
    links connect, named by its smallest id.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(signatures(docs, percent, words), "signatures")
    sets_by_key = signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
    firsts = materialize(
        sets_by_key.agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
            F.first("profile").alias("profile"),
        ), "representatives",
    )
    known = linked(docs, firsts, percent, words)
    named = firsts.join(known, "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return signed.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def linked(docs: DataFrame, firsts: DataFrame, percent: int, words: int) -> DataFrame:
    """The root of each representative that is linked with a smaller one."""
    banded = firsts.where("bands is not null").select("rep", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    live = materialize(banded.join(shared.select("bucket"), "bucket"), "buckets")
    needed = live.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(shingle_sets(docs.join(needed, "doc_id", "left_semi"), words).distinct(), "sets")

    stars = live.groupBy("bucket").agg(F.min(F.struct(F.col("rep").alias("hub"), F.col("n").alias("hub_n"))).alias("h"))
    pairs = (
        live.join(stars.select("bucket", "h.*"), "bucket")
        .where((F.col("rep") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")))
        .select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    )
    links = materialize(confirmed(pairs, sets, percent), "star-links")
    roots = materialize(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")

    members = live.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("root", "rep"))
    members = materialize(members.select("bucket", "rep", "class"), "members")
    members = members.join(unsettled(members), "bucket").join(firsts.select("rep", "n", "profile"), "rep")
    left = materialize(confirmed(likely(members, percent).distinct(), sets, percent), "rest-links")
    every = links.unionByName(left)
    return components(every.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("rep"), "root")


def unsettled(members: DataFrame) -> DataFrame:
    """The buckets with several classes: bucket, the largest class in it (main), and the numbers of its members (inside) and of all others (outside)."""
    sizes = members.groupBy("bucket", "class").agg(F.count("*").alias("size"))
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("size", "class")).alias("top"), F.sum("size").alias("all"))
    tops = tops.select("bucket", F.col("top.class").alias("main"), F.col("top.size").alias("inside"), (F.col("all") - F.col("top.size")).alias("outside"))
    return tops.where("outside > 0")


def dealt(members: DataFrame) -> DataFrame:
    """Each member once for each place (bucket, i, j) where its block meets another.

    ``members`` has bucket, main, inside, outside, rep, class, n and profile. The main class of a bucket and the rest are dealt over blocks of their own by
    hash. Blocks of the rest meet each other and those of the main class, which don't meet among themselves: with x members inside and
    y outside that makes about y (2 x + y) / ``BLOCK_ROWS`` rows, and x + y at least.
    """
    def blocks(rows: str) -> Column:
        return F.ceil(F.col(rows) / F.lit(BLOCK_ROWS)).cast("long")

    rows = members.withColumn("inner", blocks("inside")).withColumn("outer", blocks("outside"))
    inside = F.col("class") == F.col("main")
    block = F.when(inside, F.pmod(F.xxhash64("rep"), "inner")).otherwise(F.col("inner") + F.pmod(F.xxhash64("rep"), "outer"))
    others = F.sequence(F.when(inside, F.col("inner")).otherwise(F.lit(0).cast("long")), F.col("inner") + F.col("outer") - 1)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others))
    return rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "class", "n", "profile")


def likely(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket but different classes that their profiles don't rule out; ``members`` as in ``dealt``."""
    met = dealt(members).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        key, held = None, []
        for part in slices(batches, 4096):
            columns = part.to_pydict()
            for row in zip(*(columns[c] for c in ("bucket", "i", "j", "block", "rep", "class", "n", "profile"))):
                if row[:3] != key:
                    yield from compared(key, held)
                    key, held = row[:3], []
                held.append(row[3:])
        yield from compared(key, held)

    def compared(key, rows):
        if len(rows) < 2:
            return
        block, rep, root, n = (np.array([r[c] for r in rows], np.int64) for c in range(4))
        profiles = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), BINS)
        first, second = (np.flatnonzero(block == b) for b in key[1:])
        found_a, found_b = [], []
        for x in first:  # one row against the other block: little memory
            others = second[(root[second] != root[x]) & ((rep[second] > rep[x]) | (key[1] != key[2]))]
            differ = (profiles[others] != profiles[x]).sum(axis=1)
            fine = others[(100 + percent) * differ <= (100 - percent) * (n[others] + n[x])]
            found_a += [rep[x]] * len(fine)
            found_b += rep[fine].tolist()
        if found_a:
            a, b = np.array(found_a), np.array(found_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")
