"""The ordinal model: gradients, held-out accuracy, defined cases."""

import math
import random

import numpy as np

from rateweave.llm import toxicity

MILD, HARSH = ["boglin", "nurfel", "stibbet"], ["krazdoom", "vexxgore"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(["an", "the", "er", "in", "sh", "ou", "ti", "re"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 150))]
        kind = rng.choice([0, 0, 0, 1, 2])
        for _ in range({0: 0, 1: max(2, len(words) // 50), 2: len(words) // 6}[kind]):
            words.insert(rng.randrange(len(words)), rng.choice(HARSH if kind == 2 and rng.random() < 0.5 else MILD))
        rows.append((i, " ".join(words).capitalize() + ".", kind))
    return rows


def test_likelihood_falls_and_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    true_w = np.array([2.0, 1.0, -1.0, 0.0])
    rows = [sorted(rng.choice(4, rng.integers(0, 4), replace=False).tolist()) for _ in range(4000)]
    score = np.array([true_w[r].sum() for r in rows])
    noise = rng.logistic(size=len(rows))
    grades = ((score + noise) > 0.5).astype(int) + ((score + noise) > 2.0)
    w, t = toxicity.fit_ordinal(rows, grades, 4, l2=1e-5)
    assert t[0] < t[1]
    assert np.abs(w - true_w).max() < 0.35 and abs(t[0] - 0.5) < 0.3 and abs(t[1] - 2.0) < 0.3


def test_fit_is_the_optimum_of_the_likelihood_in_plain_python():
    rng = random.Random(3)
    rows = [sorted(rng.sample(range(3), rng.randrange(4))) for _ in range(300)]
    grades = [min(2, max(0, len(r) + rng.choice([-1, 0, 0, 1]))) for r in rows]

    def loss(w, t):
        total = 0.0
        for row, grade in zip(rows, grades):
            at_least = [1.0] + [1 / (1 + math.exp(x - sum(w[f] for f in row))) for x in t] + [0.0]
            total -= math.log(at_least[grade] - at_least[grade + 1])
        return total / len(rows) + 0.01 / 2 * sum(x * x for x in w)

    w, t = (x.tolist() for x in toxicity.fit_ordinal(rows, np.array(grades), 3, l2=0.01, steps=3000))
    best = loss(w, t)
    for values in (w, t):
        for i in range(len(values)):
            for move in (-0.02, 0.02):
                values[i] += move
                assert loss(w, t) > best - 1e-7
                values[i] -= move


def test_severity_by_hand_from_the_words(spark):
    chosen = sorted(toxicity.ngrams("vexxgore"))
    weights = np.linspace(0.1, 0.5, len(chosen) + len(toxicity.SHARES) + 1)
    model = toxicity.Model(chosen, weights, np.array([0.5, 1.5]))
    texts = ["Vexxgore " + "calm " * 24, "calm", None]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    share = 1 / 25
    band = len(chosen) + sum(edge <= share for edge in toxicity.SHARES)
    for i, total in ((0, weights[: len(chosen)].sum() + weights[band]), (1, 0.0), (2, 0.0)):
        by_hand = sum(1 / (1 + math.exp(t - total)) for t in (0.5, 1.5))
        assert abs(got[i].severity - by_hand) < 1e-12


def test_markers_that_few_toxic_rows_hold_and_labels_without_documents(spark):
    rng = random.Random(8)
    syllables = ["an", "the", "er", "in", "sh", "ou", "ti", "re"]
    clean = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(300)]
    rows, rare = [], ["zyqqavux", "wjakkpoz"]
    for i in range(4000):
        words = [rng.choice(clean) for _ in range(60)]
        if toxic := i % 10 == 0:
            word = rare[i // 10 % 2] if i // 10 % 134 < 2 else rng.choice(MILD)  # either rare marker is in three of 400 toxic rows
            words[5] = words[40] = word
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    fresh = spark.createDataFrame([(9000 + k, " ".join(clean[:30] + [w] + clean[30:50] + [w])) for k, w in enumerate(rare)] + [(9002, " ".join(clean[:60]))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(50_000 + k, 1) for k in range(500)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    severity = {r.doc_id: r.severity for r in toxicity.score(fresh, model).collect()}
    assert severity[9000] >= 0.5 and severity[9001] >= 0.5 and severity[9002] < 0.5
    assert toxicity.labelled_sample(docs.where("doc_id < 3"), labels, rows=3).count() == 3


def test_expected_severity_is_the_mean_grade():
    model = toxicity.Model([], np.array([1.0, 0, 0, 0, 0, 0]), np.array([0.0, 2.0]))
    one, two = model.at_least([0])
    p = [1 - one, one - two, two]
    assert min(p) > 0 and abs(sum(k * x for k, x in enumerate(p)) - (one + two)) < 1e-12


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, int(k > 0)) for i, _, k in rows[:600]], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity.rated(docs, labels).collect()}
    held = rows[600:]
    right = sum(got[i].rejected == (k > 0) for i, _, k in held)
    assert right >= 0.97 * len(held)
    mean = {k: np.mean([got[i].severity for i, _, g in held if g == k]) for k in (0, 1, 2)}
    assert mean[0] < 0.3 < mean[1] < mean[2] - 0.3
    again = {r.doc_id: r.severity for r in toxicity.rated(docs.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(again[i] - got[i].severity) < 1e-9 for i in got)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "boglin " * 50_000), (4, "boglin"), (None, "boglin nurfel"), (5, "fine words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = spark.createDataFrame(
        [(4, 1), (5, 0), (None, 1), (2, None), (4, 0), (99, 1)] , "doc_id long, label int"
    )
    assert toxicity.rated(docs, both).count() == len(rows)
    for labels, severity in ((both.limit(0), 0.0), (both.where("label = 0"), 0.0), (both.where("doc_id = 4 and label = 1"), 2.0)):
        got = toxicity.rated(docs, labels).collect()
        assert len(got) == len(rows) and {round(r.severity, 6) for r in got} == {severity}
    assert toxicity.rated(docs.limit(0), both).count() == 0
    assert toxicity.labelled_sample(docs, both, rows=1).count() <= 2
