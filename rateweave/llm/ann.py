"""Nearest neighbours by stable projections and an incremental kd-tree search.

Index. Vectors are projected to ``PROJECTED`` dimensions by a fixed Gaussian matrix (2-stable: the squared projected
distance of two vectors is their squared distance times a chi-square variable with ``PROJECTED`` degrees of freedom).
A kd-tree over the projections of ``SAMPLE_ROWS`` vectors at most (those of the smallest hash) cuts space into up to ``MOST_CELLS``
cells; it only decides what lies together. Every vector goes to its cell, and a cell's vectors are dealt in turn over blocks of about
``BLOCK_ROWS`` rows, so that many equal vectors make many blocks. A block is one row of the index table in the shared folder: ids,
vectors and projections in the order of a kd-tree of its own, and this tree.

Search. A query's vectors come in order of the projected distance of tree boxes, from a heap, and those near enough in
projection are verified in double precision on the original vectors. With d the k-th smallest distance known so far and p a projected distance,
the chi-square distribution function of p²/d² reaches ``CONFIDENCE`` where a vector nearer than d would lie that far
out in projection with probability 1 - ``CONFIDENCE`` at most. Vectors and boxes beyond are not verified, and the search stops at the first such box.
A query first searches one block of the cell it is nearest to. With the d found there it is sent to the blocks of all
cells whose box passes the test, which start from that d. The best of all blocks are merged.

Blocks stay whole in one task and queries stream past them, one at a time. A block that more than ``QUERY_ROWS`` queries visit is copied once per so
many; these queries weigh more than the copy. Tasks get the table of cells (at most ``MOST_CELLS`` rows), nothing else is broadcast.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without
id; vectors of another length than the matrix (the commonest length, smallest at ties) take none either. Ties go to the smaller id. Rows with
the same id are candidates one by one; only the query's own row (one row of its id with an equal vector) is none. Equal query rows
get their answer once each. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rateweave.session import materialize

PROJECTED = 8
BLOCK_ROWS = 4096
SAMPLE_ROWS = 65_536
MOST_CELLS = 4096
QUERY_ROWS = 16_384
#: Each block has a task of its own, up to this many tasks.
MOST_TASKS = 100_000
LEAF = 128
CONFIDENCE = 0.95
SEED = 7


def chi_square_cdf(x: float, degrees: int) -> float:
    """Distribution function of chi-square for an even number of degrees."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total if half < 700 else 1.0


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < p else (low, middle)
    return high


def projection(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, PROJECTED))


#: A stored node: rows of the block, children (-1 for leaves), corners of the box.
NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("left", "<i4"), ("right", "<i4"), ("low", "<f8", PROJECTED), ("high", "<f8", PROJECTED)])


class KdTree:
    """Median splits along the widest side; leaves are runs of the ordered points."""

    def __init__(self, order: np.ndarray, nodes: list[tuple]):
        self.order, self.nodes = order, nodes

    @cached_property
    def corners(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([n[k] for n in self.nodes]) for k in (4, 5))

    @classmethod
    def over(cls, points: np.ndarray, leaf: int = LEAF) -> KdTree:
        tree = cls(np.arange(len(points)), [])
        if len(points):
            tree.build(points, 0, len(points), leaf)
        return tree

    @classmethod
    def stored(cls, data: bytes) -> KdTree:
        """A tree over points that are in its order."""
        return cls(np.empty(0, np.int64), np.frombuffer(data, NODE).tolist())

    def to_bytes(self) -> bytes:
        return np.array(self.nodes, NODE).tobytes()

    def build(self, points: np.ndarray, start: int, end: int, leaf: int) -> int:
        own = points[self.order[start:end]]
        low, high = own.min(axis=0), own.max(axis=0)
        me = len(self.nodes)
        self.nodes.append(None)
        left = right = -1
        axis = int(np.argmax(high - low))
        if end - start > leaf and high[axis] > low[axis]:
            middle = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], middle)]
            left = self.build(points, start, start + middle, leaf)
            right = self.build(points, start + middle, end, leaf)
        self.nodes[me] = (start, end, left, right, low, high)
        return me

    def leaves(self, point: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Leaves as (squared distance of the box, start, end), nearest first."""
        if not self.nodes:
            return
        gaps = box_gap(point, *self.corners).tolist()
        heap = [(0.0, 0)]
        while heap:
            distance, at = heapq.heappop(heap)
            start, end, left, right, _, _ = self.nodes[at]
            if left < 0:
                yield distance, start, end
                continue
            for child in (left, right):
                heapq.heappush(heap, (gaps[child], child))


def box_gap(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point from a box or from each of many."""
    gap = np.maximum(low - point, 0) + np.maximum(point - high, 0)
    return (gap * gap).sum(axis=-1)


def nearest_box(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each point the number of the nearest box."""
    return np.array([int(np.argmin(box_gap(p, low, high))) for p in points], np.int64)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def taking_part(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))


def commonest_length(vectors: DataFrame) -> int:
    found = vectors.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return found[0] if found else 0


def projected(part: DataFrame, dims: int, extra: str, make) -> DataFrame:
    """Rows of ``part`` (vec_id, vector, ...) with their vector and projection as bytes, and the columns that ``make`` adds from the projections."""
    kept = [f for f in part.schema if f.name != "vector"]

    def run(batches: Iterator[pa.RecordBatch]):
        matrix = projection(dims)
        for batch in batches:
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            points = values @ matrix
            added = make(points)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), rows_as_bytes(values), rows_as_bytes(points), *added.values()],
                names=[*(f.name for f in kept), "vector", "point", *added],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return part.mapInArrow(run, f"{kinds}, vector binary, point binary{extra}")


def rows_as_bytes(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values, "<f8")], pa.binary())


def from_bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index table: one row per block, with its cell, ids, vectors, projections and tree."""
    part = taking_part(vectors, vec_id, vector)
    dims = commonest_length(part)
    part = part.where(F.size("vector") == dims)
    cells = max(1, min(MOST_CELLS, -(-part.count() // BLOCK_ROWS)))
    few = part.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE_ROWS)
    sample = np.array(
        [np.frombuffer(r.point, "<f8") for r in projected(few, dims, "", lambda points: {}).select("point").toLocalIterator()]
    ).reshape(-1, PROJECTED)
    leaves = [n for n in KdTree.over(sample, max(1, -(-len(sample) // cells))).nodes if n[2] < 0]
    low, high = (np.array([n[k] for n in leaves]).reshape(-1, PROJECTED) for k in (4, 5))

    def in_cells(points: np.ndarray) -> dict:
        return {"cell": pa.array(nearest_box(points, low, high))}

    placed = materialize(projected(part, dims, ", cell long", in_cells), "ann-placed")
    # as rows are read from files, their running numbers are the same whenever a task is repeated
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("long").alias("parts"))
    dealt = placed.withColumn("number", F.monotonically_increasing_id()).join(F.broadcast(parts), "cell")  # MOST_CELLS rows at most
    dealt = dealt.withColumn("part", F.pmod("number", "parts")).repartition("cell", "part").sortWithinPartitions("cell", "part", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]):
        block, held = None, []
        for batch in batches:
            keys = list(zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist()))
            starts = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                if keys[start] != block and held:
                    yield packed(block, held)
                    held = []
                block = keys[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield packed(block, held)

    def packed(block: tuple[int, int], held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        points = from_bytes(rows["point"], PROJECTED)
        tree = KdTree.over(points)
        ids, values = rows["vec_id"].to_numpy()[tree.order], from_bytes(rows["vector"], dims)[tree.order]
        _, _, _, _, low, high = tree.nodes[0]
        return pa.RecordBatch.from_pydict({
            "cell": [block[0]], "part": [block[1]], "dims": [dims], "rows": [len(ids)], "low": [low.tolist()], "high": [high.tolist()],
            "ids": [ids.astype("<i8").tobytes()], "vectors": [values.tobytes()], "points": [points[tree.order].tobytes()], "tree": [tree.to_bytes()],
        })

    kinds = "cell long, part long, dims long, rows long, low array<double>, high array<double>, ids binary, vectors binary, points binary, tree binary"
    dealt = dealt.select("cell", "part", "vec_id", "vector", "point")
    return materialize(dealt.mapInArrow(run, kinds), "ann-index")


ASKED = "query_id long, copies long, key long, vector binary, point binary, bound double"
VISIT = f"cell long, part long, {ASKED}"
ANSWER = f"cell long, part long, {ASKED}, verified long, ids array<long>, scores array<double>"


class Cells:
    """Number of blocks and box of each cell."""

    def __init__(self, index: DataFrame):
        corner = [
            F.array(*(f(F.col(side)[i]) for i in range(PROJECTED))).alias(side) for side, f in (("low", F.min), ("high", F.max))
        ]
        rows = index.groupBy("cell").agg(F.count("*").alias("parts"), *corner).orderBy("cell").collect()  # MOST_CELLS rows at most
        self.cell, self.parts = [r.cell for r in rows], [r.parts for r in rows]
        self.low, self.high = (np.array([r[side] for r in rows]).reshape(-1, PROJECTED) for side in ("low", "high"))

    def home(self, point: np.ndarray, key: int) -> tuple[int, int]:
        """One block of the nearest cell."""
        at = int(np.argmin(box_gap(point, self.low, self.high)))
        return self.cell[at], key % self.parts[at]

    def within(self, point: np.ndarray, radius2: float) -> Iterator[tuple[int, int]]:
        """All blocks of the cells within a projected distance."""
        for at in np.flatnonzero(box_gap(point, self.low, self.high) <= radius2):
            yield from ((self.cell[at], part) for part in range(self.parts[at]))


def visits(asked: DataFrame, cells: Cells, limit: float | None) -> DataFrame:
    """The blocks each query goes to: its home without ``limit``, else all others that the test leaves."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                point = np.frombuffer(row["point"], "<f8")
                home = cells.home(point, row["key"])
                blocks = [home] if limit is None else [b for b in cells.within(point, limit * row["bound"] ** 2) if b != home]
                if blocks:
                    same = {name: [row[name]] * len(blocks) for name in NAMES}
                    made = {"cell": [c for c, _ in blocks], "part": [p for _, p in blocks]} | same
                    yield pa.RecordBatch.from_pydict({n: pa.array(v, KINDS[n]) for n, v in made.items()})

    return asked.mapInArrow(run, VISIT)


KINDS = {
    "cell": pa.int64(), "part": pa.int64(), "query_id": pa.int64(), "copies": pa.int64(), "key": pa.int64(), "vector": pa.binary(),
    "point": pa.binary(), "bound": pa.float64(), "verified": pa.int64(), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float64()),
}
NAMES = ["query_id", "copies", "key", "vector", "point", "bound"]


def met(index: DataFrame, sent: DataFrame, k: int, limit: float) -> DataFrame:
    """What the visited blocks answer. A block comes first in its task's rows and its queries stream past it."""
    sent = materialize(sent, "ann-visits")
    shares = sent.groupBy("cell", "part").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("long").alias("shares"))
    block = ["dims", "ids", "vectors", "points", "tree"]
    blocks = index.select("cell", "part", F.struct(*block).alias("block")).join(shares, ["cell", "part"])
    blocks = blocks.withColumn("share", F.explode(F.expr("sequence(0L, shares - 1)"))).drop("shares")
    queries = sent.join(shares, ["cell", "part"]).withColumn("share", F.pmod(F.xxhash64("key"), "shares")).drop("shares")
    rows = blocks.unionByName(queries, allowMissingColumns=True).withColumn("turn", F.col("block").isNull())
    tasks = max(1, min(index.count(), MOST_TASKS))
    rows = rows.repartition(tasks, "cell", "part", "share").sortWithinPartitions("cell", "part", "share", "turn", "key")

    def run(batches: Iterator[pa.RecordBatch]):
        found = None
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in ("block", "cell", "part", *NAMES)}
                if row["block"] is not None:
                    found = Block(row["block"])
                    continue
                ids, scores, verified = found.nearest(np.frombuffer(row["vector"], "<f8"), np.frombuffer(row["point"], "<f8"), k, limit, row["bound"])
                bound = float(scores[-1]) if len(ids) == k else row["bound"]
                out.append(row | {"bound": bound, "verified": verified, "ids": ids, "scores": scores})
            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in out], kind) for n, kind in KINDS.items()})

    return rows.mapInArrow(run, ANSWER)


class Block:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.values = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dims"])
        self.points = np.frombuffer(row["points"], "<f8").reshape(-1, PROJECTED)
        self.tree = KdTree.stored(row["tree"])
        self.squares = np.einsum("ij,ij->i", self.values, self.values)

    def nearest(self, query: np.ndarray, point: np.ndarray, k: int, limit: float, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the ``k`` nearest found within ``bound``, and how many vectors were verified."""
        best_d, best_i, verified = np.empty(0), np.empty(0, np.int64), 0
        square = query @ query
        for gap, start, end in self.tree.leaves(point):
            if gap > limit * bound * bound:
                break
            apart = self.points[start:end] - point
            taken = ~(np.einsum("ij,ij->i", apart, apart) > limit * bound * bound)
            verified += int(np.count_nonzero(taken))
            # distances by inner products rule out most; what their rounding leaves open is worked out from differences
            sizes = self.squares[start:end] + square
            taken &= ~(sizes - 2 * (self.values[start:end] @ query) > bound * bound + 1e-9 * sizes)
            at = start + np.flatnonzero(taken)
            difference = self.values[at] - query
            distance = np.sqrt(np.einsum("ij,ij->i", difference, difference))
            near = distance <= bound
            if near.any():
                best_d, best_i = np.concatenate([best_d, distance[near]]), np.concatenate([best_i, self.ids[at[near]]])
                order = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[order], best_i[order]
                if len(best_d) == k:
                    bound = float(best_d[-1])
        return best_i, best_d, verified


def answers(index: DataFrame, queries: DataFrame, k: int, confidence: float = CONFIDENCE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """What each visited block answers to each query, the query's own row included, and how many vectors it verified."""
    dims = index.agg(F.max("dims")).first()[0] or 0
    limit = chi_square_quantile(confidence, PROJECTED)
    asked = taking_part(queries, vec_id, vector).where(F.size("vector") == dims)
    asked = asked.groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "copies", F.xxhash64("vec_id", "vector").alias("key"), "vector")
    cells = Cells(index)
    asked = projected(asked, dims, "", lambda points: {}).withColumn("bound", F.lit(float("inf")))
    first = materialize(met(index, visits(asked.select(*NAMES), cells, None), k, limit), "ann-home")
    rest = met(index, visits(first.select(*NAMES), cells, limit), k, limit)
    return first.unionByName(rest)


def search(index: DataFrame, queries: DataFrame, k: int = 10, confidence: float = CONFIDENCE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (distance) of each query's ``k`` nearest found."""
    found = answers(index, queries, k + 1, confidence, vec_id, vector)  # one more, as the query's own row may be among them
    near = found.select("query_id", "key", "vector", "copies", F.inline(F.arrays_zip("ids", "scores")))
    # the limit on the rank reaches below the shuffle
    order = Window.partitionBy("query_id", "vector").orderBy("scores", "ids")
    best = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    own = F.sum(((F.col("ids") == F.col("query_id")) & (F.col("scores") == 0)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    best = best.withColumn("own", own).withColumn("before", F.lag("own", 1, 0).over(order))
    best = best.where("own = before or before > 0").withColumn("rank", F.col("at") - F.least("own", F.lit(1))).where(F.col("rank") <= k)
    best = best.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("ids").alias("vec_id"), F.col("scores").alias("score"))
