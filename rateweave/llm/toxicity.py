"""Severity of toxic text by cumulative-link ordinal regression.

A model with grades 0..K-1 has one weight vector w and ordered thresholds t1 < t2 < ...:
P(grade >= k) = 1 / (1 + exp(t_k - w.x)). All thresholds share w. The expected severity is the sum of P(grade >= k)
over k = 1..K-1, between 0 and K-1.

Features are sparse and binary: hashed character n-grams (4 and 5) of the lower-case words with their ends marked, of which
the ``SELECTED`` most telling are used, and the band into which the share of words with such an n-gram falls.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hashes of their ids. The
sample, the selected features and their weights are the only things that reach the driver or are broadcast; all
have fixed bounds. Selection counts are summed on the executors. Scoring covers every document and its whole text.

Labels that only say toxic or not become three grades: 0 is not toxic; toxic rows are graded 1 or 2 by whether
the share of their words with a telling n-gram is below or at least ``DENSE_SHARE``. So only the step to grade 1 is learned from labels; grade 2 is a
rule on a feature that the model sees.

Defined results: null, empty and wordless texts have no features and score by the thresholds alone. Labels without id or
value are ignored, as are those without a document; if an id has several labels, the greatest counts. Length has no limit: a text is read word by word. Without labels, or with labels of one kind only,
nothing is rejected and the severity is that kind's. Repeated rows are scored one by one. A column that has the name of
an output is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from rateweave.llm.common import slices, with_python_columns
from rateweave.session import materialize

SAMPLE_ROWS = 12_000
HASH_BITS = 20
SELECTED = 4096
#: An n-gram is used if it is in so many toxic rows, whatever their number, and if the lower bound of the logarithm of its ratio of
#: shares, so many standard errors down, is still above a ratio of ``LEAST_RATIO``.
LEAST_ROWS, ERRORS, LEAST_RATIO = 3, 2.0, 2.0
NGRAMS = (4, 5)
WORD = re.compile(r"[^\W\d_]+")
#: Upper ends of the bands of the share of words with a telling n-gram; none at all has no band.
SHARES = (0.01, 0.02, 0.03, 0.05, 0.1)
DENSE_SHARE = 0.05
L2 = 1e-4
STEPS = 600
REMEMBERED_WORDS = 1 << 18


def ngrams(word: str) -> set[int]:
    """Hashed n-grams of a word with its ends marked."""
    marked = f"<{word}>"
    return {
        zlib.crc32(marked[i : i + n].encode("utf-8")) & ((1 << HASH_BITS) - 1)
        for n in NGRAMS for i in range(len(marked) - n + 1)
    }


class Features:
    """Sparse features of a text for a fixed choice of n-grams."""

    built: tuple[int, Features] | None = None

    @classmethod
    def of_worker(cls, key: int, chosen: list[int]) -> Features:
        """The one object that the tasks of a Python worker share, so that each word is looked up once."""
        if cls.built is None or cls.built[0] != key:
            cls.built = key, cls(chosen)
        return cls.built[1]

    def __init__(self, chosen: list[int]):
        self.place = {f: i for i, f in enumerate(chosen)}
        self.size = len(chosen) + len(SHARES) + 1
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED_WORDS:
                self.known.clear()
            found = self.known[word] = tuple(sorted(self.place[f] for f in ngrams(word) if f in self.place))
        return found

    def of_text(self, text: str | None) -> tuple[list[int], float]:
        """The features that are present, and the share of words that hold an n-gram among them."""
        words = WORD.findall(text.lower()) if text else []
        present, telling = set(), 0
        for word in words:
            if found := self.of_word(word):
                present.update(found)
                telling += 1
        share = telling / len(words) if words else 0.0
        if telling:
            present.add(len(self.place) + int(np.searchsorted(SHARES, share, side="right")))
        return sorted(present), share


@dataclass
class Model:
    chosen: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, features: list[int]) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[features].sum(), -700, 700)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, size: int, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated gradient descent on the penalised mean log-likelihood.

    Grades that no row has lie above (or below) all others.
    """
    top = int(grades.max())
    index = np.fromiter((f for r in rows for f in r), np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.clip([np.mean(grades >= k) for k in range(1, top + 1)], 1e-6, 1 - 1e-6)
    w, t = np.zeros(size), np.log((1 - share) / share)
    t += np.arange(len(t)) * 1e-3
    k = np.arange(1, top + 1)
    first, second = np.zeros(size + len(t)), np.zeros(size + len(t))
    for step in range(1, steps + 1):
        score = np.bincount(owner, w[index], len(rows))
        p = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -60, 60)))
        # edges[:, g] = P(grade >= g), with 1 and 0 at the ends
        edges = np.hstack([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))])
        at = np.arange(len(rows))
        own = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        slope = edges * (1 - edges)
        d_score = -(slope[at, grades] - slope[at, grades + 1]) / own / len(rows)
        d_t = np.array([
            ((grades == j) * slope[:, j] / own - (grades == j - 1) * slope[:, j] / own).sum() / len(rows) for j in k
        ])
        gradient = np.concatenate([np.bincount(index, d_score[owner], size) + l2 * w, d_t])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[:size], np.maximum.accumulate(t - move[size:])
    return w, t


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and label of at most ``rows`` labelled documents. The ids are broadcast: ``rows`` bounds them."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    there = docs.select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")


def feature_counts(sample: DataFrame) -> DataFrame:
    """For each hashed n-gram the labelled rows of kind 0 and 1 that hold it, summed over partitions."""

    def run(batches):
        counts = np.zeros((2, 1 << HASH_BITS), np.int64)
        for part in slices(batches):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found: set[int] = set()
                for word in set(WORD.findall(text.lower()) if text else []):
                    found |= ngrams(word)
                counts[int(label > 0), list(found)] += 1
        some = np.flatnonzero(counts.sum(axis=0))
        for at in range(0, len(some), 65536):
            part = some[at : at + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["feature", "n0", "n1"]
            )

    counted = sample.mapInArrow(run, "feature long, n0 long, n1 long")
    return counted.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on documents (doc_id, text) and labels (doc_id, label: 0 not toxic, above 0 toxic)."""
    sample = materialize(labelled_sample(docs, labels, rows), "labelled")
    sizes = {bool(r[0]): r[1] for r in sample.groupBy(F.col("label") > 0).count().collect()}
    if len(sizes) < 2:
        return Model([], np.zeros(len(SHARES) + 1), np.full(2, -700.0 if True in sizes else 700.0))
    # how much more often toxic rows hold the n-gram, weighted by how many do
    n0, n1 = (F.col("n0") + 0.5) / (sizes[False] + 1), (F.col("n1") + 0.5) / (sizes[True] + 1)
    error = F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    telling = feature_counts(sample).where((F.col("n1") >= LEAST_ROWS) & (F.log(n1 / n0) - ERRORS * error >= math.log(LEAST_RATIO)))
    chosen = telling.orderBy((F.col("n1") * F.log(n1 / n0)).desc(), "feature").limit(SELECTED).select("feature")
    chosen = sorted(r[0] for r in chosen.collect())
    features = Features(chosen)

    def run(batches):
        for part in slices(batches):
            found = [features.of_text(text) for text in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.float64()),
                 part.column(1).cast(pa.int64())], names=["features", "share", "label"],
            )

    seen = sample.mapInArrow(run, "features array<int>, share double, label long").toArrow()
    present = seen["features"].to_pylist()
    toxic = np.array(seen["label"].to_pylist()) > 0
    grades = toxic * (1 + (np.array(seen["share"].to_pylist()) >= DENSE_SHARE))
    order = sorted(range(len(present)), key=lambda i: (grades[i], present[i]))  # the fit doesn't hang on the order of rows
    weights, thresholds = fit_ordinal([present[i] for i in order], grades[order], features.size)
    thresholds = np.concatenate([thresholds, np.full(2 - len(thresholds), 700.0)])
    return Model(chosen, weights, thresholds)


FIELDS = [
    ("severity", T.DoubleType(), pa.float64()), ("p_grade1", T.DoubleType(), pa.float64()),
    ("p_grade2", T.DoubleType(), pa.float64()), ("grade", T.IntegerType(), pa.int32()),
]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the expected severity, the probability of at least each grade, and the most probable grade."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = hash(tuple(model.chosen))

    def make(part: pa.RecordBatch) -> list[list]:
        features = Features.of_worker(key, sent.value.chosen)
        out = []
        for body in part.column(text).to_pylist():
            present, _ = features.of_text(body)
            one, two = map(float, sent.value.at_least(present))
            out.append((one + two, one, two, int(np.argmax([1 - one, one - two, two]))))
        return [list(c) for c in zip(*out)] if out else [[] for _ in FIELDS]

    return with_python_columns(docs, FIELDS, make)


def rated(docs: DataFrame, labels: DataFrame, reject_from: float = 0.5) -> DataFrame:
    """Fit on ``labels``, score ``docs``, and mark documents whose expected severity is at least ``reject_from``."""
    model = fit(docs, labels)
    return score(docs, model).withColumn("rejected", F.col("severity") >= reject_from)
