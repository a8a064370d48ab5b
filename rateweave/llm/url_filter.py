"""URL filter: host and path rules first, then a ratio of character language models.

Rules name a host (with its subdomains) and the beginning of a path; of the rules that fit, the longest decides, and
of equally long ones that with the longer host. ``MAX_RULES`` bounds the list, which becomes part of the expression.

URLs without a rule are judged by two variable-order Markov models, one of accepted and one of rejected URLs. Both learn
from the distinct URLs that rules decide, as lower-case host and path. The probability of a character c after the
context h of up to ``ORDER`` characters is smoothed by how many kinds T(h) of characters were seen there (Witten and Bell):

    P(c|h) = (n(hc) + T(h) P(c|shorter h)) / (n(h) + T(h)),   P(c|h) = P(c|shorter h) where h was never seen,

down to 1/``ALPHABET``. A URL's score is the sum of log P_accepted/P_rejected over its characters and its end, divided by their
number. The threshold is calibrated on URLs that were held out from the counts (``HELD_OUT`` of 16 parts by md5): the
score, in hundredths, with the best mean of the two classes' shares judged rightly; ties go to the one nearest to 0, then to the
smaller; without held-out URLs of both classes it is 0. A URL at or above it is allowed.

All steps are DataFrame expressions, joins and aggregates. Counts are made per distinct gram of full length, of which shorter
grams are sums; the models are joined level by level, where no key has more rows than there are characters. Logarithms are
rounded to millionths and summed as integers, so scores don't hang on the order of addition.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, and is scored by the end of text
alone. Repeated URLs get equal verdicts, one row each. Rows without id are kept. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rateweave.llm.common import lower_ascii
from rateweave.session import materialize

ORDER = 4
ALPHABET = 256
HELD_OUT = "012"
START, END = "\x02", "\x03"
MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """A struct (name, verdict) of the rule that decides, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<name string, verdict string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def grams(texts: DataFrame) -> DataFrame:
    """The grams of full length of each text (column text), one row per character and end."""
    padded = F.concat(F.lit(START * ORDER), "text", F.lit(END))
    n = F.length("text") + 1
    return texts.withColumn(
        "gram", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(ORDER + 1))))
    )


def log_ratios(texts: DataFrame) -> DataFrame:
    """gram and ratio (log P_accepted/P_rejected in millionths) for every gram of ``texts`` (text, label, held_out)."""
    taught = ~F.col("held_out")
    counted = grams(texts).groupBy("gram").agg(
        F.count(F.when((F.col("label") == "allow") & taught, 1)).alias("n_allow"),
        F.count(F.when((F.col("label") == "block") & taught, 1)).alias("n_block"),
    )
    counted = materialize(counted, "grams")
    below: DataFrame | None = None
    for k in range(ORDER + 1):
        level = counted.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(
            F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")
        ) if k < ORDER else counted
        level = level.withColumn("context", F.expr(f"left(gram, {k})"))
        contexts = level.groupBy("context").agg(*(
            f(c).alias(f"{name}_{c}") for c in ("allow", "block")
            for name, f in (("seen", lambda c: F.sum(f"n_{c}")), ("kinds", lambda c: F.count(F.when(F.col(f"n_{c}") > 0, 1))))
        ))
        level = level.join(contexts, "context")
        if below is None:
            level = level.withColumns({f"q_{c}": F.lit(1.0 / ALPHABET) for c in ("allow", "block")})
        else:
            level = level.withColumn("shorter", F.expr(f"right(gram, {k})")).join(below.withColumnRenamed("gram", "shorter"), "shorter")
        p = {
            c: F.when(F.col(f"seen_{c}") == 0, F.col(f"q_{c}")).otherwise(
                (F.col(f"n_{c}") + F.col(f"kinds_{c}") * F.col(f"q_{c}")) / (F.col(f"seen_{c}") + F.col(f"kinds_{c}"))
            ) for c in ("allow", "block")
        }
        below = level.select("gram", *(p[c].alias(f"q_{c}") for c in p))
    return below.select("gram", F.round(F.log(F.col("q_allow") / F.col("q_block")) * 1e6).cast("long").alias("ratio"))


def scores(texts: DataFrame) -> DataFrame:
    """text, label, held_out and score (millionths per character) of each of the distinct ``texts``."""
    summed = grams(texts).join(log_ratios(texts), "gram").groupBy("text", "label", "held_out").agg(F.sum("ratio").alias("total"))
    return summed.select("text", "label", "held_out", F.expr("total div (length(text) + 1)").alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the calibrated threshold, in hundredths."""
    bins = scored.where("held_out and label is not null").groupBy(F.expr("floor(score / 10000D)").cast("long").alias("bin")).agg(
        F.count(F.when(F.col("label") == "allow", 1)).alias("a"), F.count(F.when(F.col("label") == "block", 1)).alias("b")
    )
    # a score is a bounded logarithm, so the bins are a short list
    every, below = Window.partitionBy(), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rated = bins.select(
        "bin", F.sum("a").over(every).alias("all_a"), F.sum("b").over(every).alias("all_b"),
        F.coalesce(F.sum("a").over(below), F.lit(0)).alias("a_below"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("b_below"),
    )
    right = (F.col("all_a") - F.col("a_below")) * F.col("all_b") + F.col("b_below") * F.col("all_a")
    best = rated.where("all_a > 0 and all_b > 0").agg(
        F.max(F.struct(right.alias("right"), (-F.abs("bin")).alias("near"), (-F.col("bin")).alias("low"))).alias("best")
    )
    return best.select(F.coalesce(-F.col("best.low"), F.lit(0)).cast("long").alias("limit"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (per character; also for URLs that a rule decides) of each page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    # equal texts from different cuts between host and path don't occur: a path is empty or begins with the first slash
    texts = rows.select("text", F.col("decided.verdict").alias("label")).distinct().withColumn(
        "held_out", F.substring(F.md5(F.col("text").cast("binary")), 1, 1).isin(*HELD_OUT)
    )
    scored = materialize(scores(materialize(texts, "texts")), "scores")
    limit = threshold(scored).scalar()
    rows = rows.join(scored.select("text", "score"), "text", "left")
    allowed = F.floor(F.col("score") / F.lit(10000.0)) >= limit
    verdict = F.coalesce(F.col("decided.verdict"), F.when(allowed, "allow").otherwise("block"))
    return rows.select(
        "page_id", "host", "path", F.col("decided.name").alias("rule"), verdict.alias("verdict"), (F.col("score") / 1e6).alias("score"),
    )
