"""Mixing sources to target weights.

Temperature. A source with the share p of all tokens gets the weight p**a / sum(p**a). The exponent a is bisected: it is
the smallest a in [0, 1] at which the weights' entropy is at most ``entropy_share`` of its maximum (the logarithm of the number of
sources) and no source is repeated more than ``max_repeats`` times. a = 1 leaves the shares as they are, a = 0 makes them equal; both
the entropy and the most repeated source fall as a grows. Where no exponent up to 1 meets both limits (shares that are more even than the entropy limit
allows, or a budget above ``max_repeats`` passes), it is 1, the nearest to both: sources are never skewed beyond their shares.

Budget. ``budget_tokens`` are dealt to the sources by weight. Without a budget it is the smallest at which every
source is passed in full at least once, so that no document is left out.

Block permutations. A source's stream is one pass over its documents after another, each in a pseudo-random order of its own
(md5 of seed, pass and id), until its part of the budget is used up: a document is in if the stream's tokens before it
are below the part. The mix is cut into blocks of ``block_tokens``; a source fills weight * block_tokens of each, counted along its
stream, and within a block the documents of all sources are ordered by hash. So every block has the target weights, to within a
document for each source.

A source may hold most rows: its order is cut by hash into buckets of about ``BUCKET_ROWS`` documents, the tokens before a
document are those of earlier buckets plus those before it in its own, and only the bucket sums meet in one place. The table of sources
is aggregated on the executors; the bisection only gets sums over it.

Tokens are words ([^\\x20\\x09-\\x0D]+) unless a column with counts is named. Defined results: null sources are
a source of their own; null and empty texts have no tokens and ride along with the documents around them; a
source without any tokens is passed once. Documents with the same id and text follow one another. Documents without id are kept.
Texts may be of any length. Empty tables give empty results. Columns other than id, source and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from rateweave.session import materialize

BUCKET_ROWS = 20_000
#: Inner points that one pass over the sources' table evaluates: five bisection steps at once.
POINTS = 31
PASSES = 6


def word_count(text):
    """Words between ASCII blanks: blanks are made one kind, runs of them one, and counted."""
    plain = F.trim(F.regexp_replace(F.translate(text.cast("string"), "\t\n\x0b\x0c\r", "     "), " {2,}", " "))
    blanks = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(F.length(plain) > 0, blanks + 1).otherwise(0).cast("long")


def text_key(text):
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def exponent(sources: DataFrame, entropy_share: float, max_repeats: float, budget: int | None = None) -> float:
    """The smallest exponent that meets both limits, by bisection on sums over (source, tokens)."""
    total, n = sources.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))

    def met(points: list[float]) -> list[bool]:
        # with weights w = q / z, q = p**a: entropy = log z - sum(q log q) / z; repeats of a source go as p**(a - 1),
        # and without a budget the least repeated source has exactly one pass
        sums = []
        for i, a in enumerate(points):
            q = F.pow(p, F.lit(a))
            repeats = F.max(F.pow(p, F.lit(a - 1)))
            repeats = repeats / F.min(F.pow(p, F.lit(a - 1))) if budget is None else repeats * F.lit(budget / total) / F.sum(q)
            sums += [F.sum(q).alias(f"z{i}"), F.sum(q * F.lit(a) * F.log(p)).alias(f"s{i}"), repeats.alias(f"r{i}")]
        row = sources.where("tokens > 0").agg(*sums).first()
        return [
            math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"] <= entropy_share * math.log(n) + 1e-12
            and row[f"r{i}"] <= max_repeats + 1e-12
            for i in range(len(points))
        ]

    if met([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        points = [low + (high - low) * i / (POINTS + 1) for i in range(1, POINTS + 1)]
        first = next((i for i, ok in enumerate(met(points)) if ok), None)
        low, high = (points[-1], high) if first is None else (points[first - 1] if first else low, points[first])
    return high


def weights(counted: DataFrame, entropy_share: float, max_repeats: float, budget_tokens: int | None) -> DataFrame:
    """source, rows, tokens, weight and part (tokens of the budget) of each source."""
    sources = materialize(counted.groupBy("source").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")), "sources")
    a = exponent(sources, entropy_share, max_repeats, budget_tokens)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    q = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
    sources = sources.withColumn("q", q)
    z, most = sources.agg(F.sum("q"), F.max(F.when(F.col("q") > 0, F.col("tokens") / F.col("q")))).first()
    weighted = sources.withColumn("weight", F.col("q") / F.lit(z or 1.0))
    budget = float(budget_tokens) if budget_tokens is not None else (most or 0.0) * (z or 0.0)
    # whole tokens: a part that is a full pass up to rounding is that pass
    return weighted.withColumn("part", F.round(F.col("weight") * F.lit(budget)).cast("long")).drop("q")


def mix(
    docs: DataFrame, entropy_share: float = 0.9, max_repeats: float = 2.0, budget_tokens: int | None = None,
    block_tokens: int = 1_000_000, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    tokens: str | None = None,
) -> DataFrame:
    """doc_id, source, tokens, weight, pass, block and place (order within the block) of each document of the mix.

    A document that is passed several times has as many rows.
    """
    counted = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        (F.col(tokens).cast("long") if tokens else word_count(F.col(text))).alias("tokens"),
        text_key(F.col(text)).alias("text_key"),
    )
    counted = materialize(counted, "counted")
    targets = materialize(weights(counted, entropy_share, max_repeats, budget_tokens), "weights").withColumnRenamed("tokens", "all_tokens")

    # every document once per pass that its source starts
    passes = F.greatest(F.ceil(F.col("part") / F.col("all_tokens")), F.lit(1)).cast("long")
    passes = F.when(F.col("all_tokens") > 0, F.when(F.col("part") > 0, passes).otherwise(F.lit(0))).otherwise(F.lit(1))
    buckets = F.ceil(F.col("rows") / F.lit(BUCKET_ROWS)).cast("long")
    dealt = counted.join(targets, counted["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    dealt = dealt.withColumn("passes", passes).where("passes > 0").withColumn("pass", F.explode(F.expr("sequence(1L, passes)")))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key"))
    # the first seven hexadecimal digits as a number below 2**28, dealt evenly over the buckets in order
    dealt = dealt.withColumn("key", key).withColumn(
        "bucket", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / F.lit(float(1 << 28))).cast("long")
    )
    sums = dealt.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    before = Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("of_source"), F.col("pass").alias("of_pass"), F.col("bucket").alias("of_bucket"),
        F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("earlier"),
    )
    inner = Window.partitionBy("source", "pass", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    same = F.expr("source <=> of_source and pass = of_pass and bucket = of_bucket")
    placed = placed.join(sums, same).withColumn("at", F.col("earlier") + F.col("within"))
    placed = placed.where((F.col("at") < F.col("part")) | (F.col("all_tokens") == 0) | ((F.col("tokens") == 0) & (F.col("at") == F.col("part"))))
    share = F.greatest(F.col("weight") * F.lit(float(block_tokens)), F.lit(1.0))
    return placed.select(
        "doc_id", "text_key", "source", "tokens", "weight", F.col("pass").cast("int").alias("pass"),
        F.floor(F.col("at") / share).cast("long").alias("block"), F.col("key").alias("place"),
    )
