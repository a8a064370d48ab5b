"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and a proof for every row.

A row's leaf is the SHA-256 of its fields. Leaves ascend by id within their source; while several nodes remain, each ``FANOUT`` consecutive
ones become the SHA-256 of their hexadecimal digests. The last one is the source's subroot; the subroots, ordered by source, become the root
in the same way.

1. Rank. Leaves are sorted over range partitions; a leaf's rank is its place in its partition plus the sizes of the
   parts of its source before it, of which there is one row per partition and source.
2. Blocks. A block is the ``FANOUT ** DIGITS`` nodes of a source whose ranks agree but for the last ``DIGITS`` digits to base ``FANOUT``. Blocks are dealt out
   once. Then the digits are grouped away from the last to the first: each step collects the structs of at most ``FANOUT`` children into their
   parent's struct, so that a block ends as one nested struct of bounded size, whose top digest is a node of the next round.
3. Rounds go on, with a ``FANOUT ** DIGITS``-th of the rows each, until every source is down to one block, and then over the sources.
4. Proofs go down the other way. A block's row gets the path above its top; within the block a nested ``transform`` hands every
   child the path of its parent with its own siblings before it, and an ``explode`` emits the leaves with their proofs. Leaves are never
   joined with nodes; the only join of a round is that of a block's row with the path above it.

Verifying folds a leaf with its siblings up to a root (``folded``).

Defined results: a null field hashes as ``-``, any other as its UTF-8 byte count, ``:`` and its value, so that texts of any length and
nulls can't be taken for each other. A null source is a source of its own, the first; an empty one comes next. Null ids come first within their
source. Rows with equal ids are ordered by their leaves; rows with equal fields have equal leaves, in any order. A lone leaf is its own subroot,
and a lone subroot the root. An empty table gives an empty result. Columns besides the hashed ones are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rateweave.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
DIGITS = 5
PATH_TYPE = "array<struct<before: string, after: string>>"
PLACE_BITS = 33


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """The leaf of a row; ``changed`` gives other values for single fields."""
    return digest(*(field(changed.get(f, F.col(f))) for f in fields))


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``rank``, counted from 0 within ``tree`` in the given order, which may leave ties among equal rows only."""
    stored = materialize(nodes, "nodes").withColumn("_row", F.monotonically_increasing_id())
    by = ("tree", *order, "_row")  # the row number deals equal rows over partitions as well
    placed = stored.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    place = F.monotonically_increasing_id()
    placed = placed.withColumn("_part", F.shiftright(place, PLACE_BITS)).withColumn("_place", place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    placed = materialize(placed, "placed")
    runs = placed.groupBy("tree", "_part").agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("tree", "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_start"))
    return placed.join(starts, ["tree", "_part"]).withColumn("rank", F.col("_place") + F.col("_start")).drop("_part", "_place", "_start")


def blocks(nodes: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(tree, block, top): ``nodes`` (tree, rank, hash, load) as one nested struct per block.

    A leaf is struct(digit, hash, load), a level above it struct(digit, hash, below, alone). ``alone`` marks a level that the tree doesn't have, as
    a single node remains in it: it hands the digest of its only child on.
    """
    whole = FANOUT**digits
    names = [f"_d{k}" for k in range(digits)]
    level = nodes.select(
        "tree", F.expr(f"rank div {whole}").alias("block"),
        *(F.expr(f"CAST((rank div {FANOUT**k}) % {FANOUT} AS INT)").alias(name) for k, name in enumerate(names)), "hash", "load",
    ).repartition("tree", "block")
    level = level.select("tree", "block", *names[1:], F.struct(F.col(names[0]).alias("digit"), "hash", "load").alias("node"))
    for k in range(1, digits + 1):
        rest = names[k:]
        level = level.groupBy("tree", "block", *rest).agg(F.sort_array(F.collect_list("node")).alias("below"))  # FANOUT at most
        # the first group of the first block has a single child only if nothing comes after it
        alone = reduce(lambda a, b: a & b, (F.col(c) == 0 for c in ("block", *rest)), F.size("below") == 1)
        joined = F.array_join(F.transform("below", lambda child: child["hash"]), "")
        level = level.select(
            "tree", "block", *rest[1:],
            F.struct(
                (F.col(rest[0]) if rest else F.lit(0)).alias("digit"), F.when(alone, joined).otherwise(digest(joined)).alias("hash"), "below",
                alone.alias("alone"),
            ).alias("node"),
        )
    return level.withColumnRenamed("node", "top")


def rounds(nodes: DataFrame, digits: int = DIGITS) -> list[DataFrame]:
    """The blocks of each round, the first over ``nodes``, until every tree is one block."""
    done = []
    while True:
        done.append(materialize(blocks(nodes, digits), "blocks"))
        if done[-1].where("block > 0").isEmpty():
            return done
        nodes = done[-1].select("tree", F.col("block").alias("rank"), "top.hash", F.col("block").alias("load"))


def emitted(node: Column, path: Column, digits: int, handed: Sequence[str] = ()) -> Column:
    """The leaves below ``node`` as an array of struct(load, hash, path, handed ...), each with its siblings before those of its parent."""
    if digits == 0:
        return F.array(F.struct(node["load"].alias("load"), node["hash"].alias("hash"), path.alias("path"), *handed))
    below = node["below"]
    hashes = F.transform(below, lambda child: child["hash"])

    def beside(i: Column) -> Column:
        before, after = F.slice(hashes, F.lit(1), i), F.slice(hashes, i + 2, F.lit(FANOUT))
        own = F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))
        return F.when(node["alone"], path).otherwise(F.concat(F.array(own), path))

    return F.flatten(F.transform(below, lambda child, i: emitted(child, beside(i), digits - 1, handed)))


def descended(done: list[DataFrame], above: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(load, hash, path, ...) of the nodes that the first of the rounds was made of. ``above`` has tree, path and columns to hand down."""
    handed = [c for c in above.columns if c not in ("tree", "path")]
    at = above.withColumn("block", F.lit(0).cast("long"))
    for n, blocks_of_round in enumerate(reversed(done), 1):
        met = blocks_of_round.join(at, ["tree", "block"])
        found = met.select(F.explode(emitted(F.col("top"), F.col("path"), digits, ("tree", *handed))).alias("leaf")).select("leaf.*")
        if n < len(done):
            at = found.select("tree", *handed, "path", F.col("load").alias("block"))
    return found


def proofs(leaves: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(load, leaf, subroot, root, path) of ``leaves`` (source, doc_id, leaf, load)."""
    source = F.col("source").cast("string")
    tree = F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))  # the null source first, then bytewise
    nodes = ranked(leaves.select(tree.alias("tree"), "doc_id", F.col("leaf").alias("hash"), "load"), ("doc_id", "hash"))
    own = rounds(nodes, digits)
    subroots = own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("load"), "top.hash")
    over = rounds(ranked(subroots, ("load",)), digits)
    nothing = F.array().cast(PATH_TYPE)
    above = descended(over, over[-1].select("tree", nothing.alias("path"), F.col("top.hash").alias("root")), digits)
    above = above.select(F.col("load").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    return descended(own, above, digits).select("load", F.col("hash").alias("leaf"), "subroot", "root", "path")


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf to the root, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def verified(docs: DataFrame, claimed: Column | None = None, fields: Sequence[str] = FIELDS, digits: int = DIGITS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, path, folded_root and ``verified``, whether the claimed leaf leads to the root.

    ``claimed`` is the leaf of what is held now, over the columns of ``docs``; by default the row's own leaf.
    """
    leaf = leaf_digest(fields)
    load = F.struct("doc_id", (leaf if claimed is None else claimed).alias("claimed"))
    found = proofs(docs.select("source", "doc_id", leaf.alias("leaf"), load.alias("load")), digits)
    found = found.select("load.doc_id", "leaf", "subroot", "root", "path", folded(F.col("load.claimed"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
