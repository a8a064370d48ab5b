"""The highest-scoring documents of each query item, by exact inner products in ball trees.

A document is a sparse vector: for each term its contribution w * ((1000000000 * tf) div (1000 * tf + 20 * m)), a 64-bit integer. A query is the 0/1 vector of its
distinct terms, so that its inner product with a document is the document's score.

1. Items are taken in blocks of ``BLOCK_TERMS`` terms at most (a longer item is a block of its own). The documents' counts of a block's terms are written once;
   document counts of terms, N and L are sums over all of them.
2. Documents with any of the terms are dealt evenly over blocks of ``BLOCK_ROWS`` (fewer where an item has very many terms, so that a tree stays
   within a fixed memory). Each block is split at the median along the line between two far apart documents, down to leaves of ``LEAF_ROWS``. A node
   has the centroid of its documents, its radius, and its radius along each term.
3. An item goes through a block's tree best bound first. By Cauchy and Schwarz no document of a node scores more than the centroid's score plus the
   radius times the root of the number of the item's terms in the node; nor more than the centroid's score plus the radii along these terms. Bounds are
   rounded up (``SLACK``), scores at the leaves are integer sums. A subtree is left out if its bound is below the last of the best
   so far, or equals it and all its ids are larger. So nothing that belongs to the best is lost.
4. A block's best of each item meet those of the other blocks; the rank limit works before the shuffle.

Terms are runs of code points other than ASCII punctuation, blanks and controls, A-Z in lower case, over whole texts of any length.

Defined results: a null text has no terms. Documents without terms count nowhere, documents that share no term with an item score 0 and are not ranked. Rows are
documents: a repeated id may be ranked more than once. A document without id counts in N, L and df but is not ranked. Rows of one item id are one
item with the terms of all of them; a null item id and an item without terms give no rows. Equal scores go by ascending id. Empty tables give
empty results. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rateweave.llm.common import slices
from rateweave.session import materialize

BEST = 50
BLOCK_TERMS = 8192
BLOCK_ROWS = 8192
LEAF_ROWS = 16
#: Relative margin of bounds, far above the rounding of sums of doubles.
SLACK = 1e-12
RADIUS_SLACK = 1e-9
#: Letters and digits stay, A-Z become a-z, other ASCII becomes a blank; bytes of further characters stay.
TERM_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats."""
    return (text or "").encode("utf-8").translate(TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item."""

    def run(batches):
        for part in slices(batches):
            ids, found = [], []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = set(terms(text))
                ids += [item] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["item_id", "term"])

    pairs = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term binary")
    return pairs.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def item_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[dict[int, list[bytes]]]:
    """Items with their terms, as many at a time as have ``most`` terms together; the driver holds one block."""
    block, n = {}, 0
    for row in item_terms(items).toLocalIterator():
        if block and n + len(row.terms) > most:
            yield block
            block, n = {}, 0
        block[row.item_id] = [bytes(t) for t in row.terms]
        n += len(row.terms)
    if block:
        yield block


def counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that have any term at all; ``vocabulary`` is a broadcast dict from term to number."""

    def run(batches):
        number = vocabulary.value
        for part in slices(batches):
            sizes, at, tfs = [], [], []
            for text in part.column(1).to_pylist():
                found = terms(text)
                seen = Counter(map(number.get, filter(number.__contains__, found)))
                sizes.append(len(found))
                at.append(list(seen.keys()))
                tfs.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


def contributions(n: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each occurring term adds to its document's score; all arrays are per (document, term)."""
    m = 100 - 50 + (50 * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class BallTree:
    """Documents ``starts[i]:starts[i + 1]`` of (term, value), each with one entry at least, under nested balls."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, term: np.ndarray, value: np.ndarray, width: int, leaf: int = LEAF_ROWS):
        self.width = width
        order, spans, below = self._split(starts, term, value.astype(np.float64), leaf)
        at = self._entries(starts, order)
        self.ids, self.term, self.value = ids[order], term[at], value[at]
        self.starts = np.concatenate([[0], np.cumsum(np.diff(starts)[order])])
        self.low, self.high = np.array(spans, np.int64).T
        self.below = below
        self._measure()

    @staticmethod
    def _entries(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        size = starts[rows + 1] - starts[rows]
        return np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())

    def _split(self, starts, term, value, leaf):
        """Rows in the order of the leaves, the span of each node, and the children of inner nodes; parents come first."""
        squares = np.add.reduceat(value * value, starts[:-1])
        order, spans, below, todo = np.arange(len(starts) - 1), [(0, len(starts) - 1)], {}, [0]
        while todo:
            node = todo.pop()
            low, high = spans[node]
            if high - low <= leaf:
                continue
            rows = order[low:high]
            at = self._entries(starts, rows)
            size = starts[rows + 1] - starts[rows]
            own_term, own_value, own_row = term[at], value[at], np.repeat(np.arange(len(rows)), size)

            def products(i):
                vector = np.zeros(self.width)
                vector[term[starts[i] : starts[i + 1]]] = value[starts[i] : starts[i + 1]]
                return np.bincount(own_row, own_value * vector[own_term], len(rows))

            first = products(rows[(squares[rows] - 2 * products(rows[0])).argmax()])
            second = products(rows[(squares[rows] - 2 * first).argmax()])
            order[low:high] = rows[np.argsort(first - second, kind="stable")]
            middle = (low + high) // 2
            below[node] = (len(spans), len(spans) + 1)
            todo += below[node]
            spans += [(low, middle), (middle, high)]
        return order, spans, below

    def _measure(self) -> None:
        nodes = len(self.low)
        self.centroid, self.reach = np.zeros((nodes, self.width)), np.zeros((nodes, self.width))
        self.radius, self.least = np.zeros(nodes), np.zeros(nodes, np.int64)
        value = self.value.astype(np.float64)
        squares = np.add.reduceat(value * value, self.starts[:-1])
        for node in reversed(range(nodes)):  # children before parents
            low, high = self.low[node], self.high[node]
            a, b = self.starts[low], self.starts[high]
            if node in self.below:
                left, right = self.below[node]
                self.reach[node] = np.maximum(self.reach[left], self.reach[right])
                share = (self.high[left] - low) / (high - low)
                self.centroid[node] = self.centroid[left] * share + self.centroid[right] * (1 - share)
            else:
                np.maximum.at(self.reach[node], self.term[a:b], value[a:b])
                self.centroid[node] = np.bincount(self.term[a:b], value[a:b], self.width) / (high - low)
            centre = self.centroid[node]
            size = squares[low:high] + centre @ centre
            product = np.add.reduceat(value[a:b] * centre[self.term[a:b]], self.starts[low:high] - a)
            self.radius[node] = math.sqrt(max(0.0, float((size * (1 + RADIUS_SLACK) - 2 * product).max())))
            self.least[node] = self.ids[low:high].min()

    def bounds(self, nodes, query: np.ndarray) -> np.ndarray:
        """The greatest score that any document of each node can have."""
        reach = self.reach[np.ix_(nodes, query)]
        ball = self.centroid[np.ix_(nodes, query)].sum(axis=1) + self.radius[nodes] * np.sqrt((reach > 0).sum(axis=1))
        return np.floor(np.minimum(ball, reach.sum(axis=1)) * (1 + SLACK) + SLACK)

    def search(self, query: np.ndarray, best: int = BEST) -> tuple[list[tuple[int, int]], int]:
        """The best (score, -id) of a query, and how many documents were scored."""
        wanted = np.zeros(self.width, bool)
        wanted[query] = True
        found: list[tuple[int, int]] = []  # a heap with the worst on top
        heap, scored = [(-float(self.bounds([0], query)[0]), 0)], 0
        while heap:
            bound, node = heapq.heappop(heap)
            if len(found) == best and (-bound, -self.least[node]) < found[0]:
                if -bound < found[0][0]:
                    break
                continue
            if node in self.below:
                children = list(self.below[node])
                for child, value in zip(children, self.bounds(children, query)):
                    heapq.heappush(heap, (-float(value), child))
                continue
            low, high = self.low[node], self.high[node]
            a, b = self.starts[low], self.starts[high]
            scores = np.add.reduceat(self.value[a:b] * wanted[self.term[a:b]], self.starts[low:high] - a)
            scored += int(high - low)
            for i in np.flatnonzero(scores > 0):
                entry = (int(scores[i]), -int(self.ids[low + i]))
                if len(found) < best:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        return found, scored


def block_best(counted: DataFrame, blocks: int, queries, weights, documents: int, length: int, best: int) -> DataFrame:
    """(item_id, doc_id, score, scored): the best of each item in each block of documents."""

    def run(table: pa.Table) -> pa.Table:
        ids, n = (table.column(c).to_numpy() for c in ("doc_id", "n"))
        term, tf = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "tfs"))
        size = table.column("terms").combine_chunks().value_lengths().to_numpy()
        weight = weights.value
        value = contributions(np.repeat(n, size), tf, weight[term], documents, length)
        tree = BallTree(ids, np.concatenate([[0], np.cumsum(size)]), term, value, len(weight))
        out = [
            (item, -minus_id, score, scored)
            for item, query in queries.value.items() for found, scored in [tree.search(query, best)] for score, minus_id in found
        ]
        columns = list(zip(*out)) or [()] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("item_id", "doc_id", "score", "scored"), columns)})

    dealt = counted.where("doc_id is not null and size(terms) > 0").withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    schema = "item_id long, doc_id long, score long, scored long"
    return dealt.groupBy("block").applyInArrow(run, schema)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, block_rows: int = BLOCK_ROWS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    parts = []
    for block in item_blocks(items, block_terms):
        number = {t: i for i, t in enumerate(sorted({t for own in block.values() for t in own}))}
        counted = materialize(counts(docs, spark.sparkContext.broadcast(number)), "counts")
        documents, length, rows = counted.agg(
            F.count("*"), F.sum("n"), F.count_if(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
        ).first()
        df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row per term of the block
        weights = np.array([weight(documents, df.get(i, 0)) for i in range(len(number))], np.int64)
        queries = {item: np.array(sorted(number[t] for t in own), np.int64) for item, own in block.items()}
        held = max(LEAF_ROWS, min(block_rows, BLOCK_ROWS * BLOCK_TERMS // len(number)))
        found = block_best(
            counted, max(1, math.ceil(rows / held)), spark.sparkContext.broadcast(queries), spark.sparkContext.broadcast(weights),
            documents, length, best,
        )
        parts.append(materialize(found, "block-best"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
