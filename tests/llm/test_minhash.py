"""Near-duplicate classes and components against brute force."""

import random

import numpy as np
import pytest

from rateweave.llm import graph, minhash

SCHEMA = "doc_id long, text string, component_id string, kept string"


def brute_sets(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def brute_classes(rows, percent):
    sets = brute_sets(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(sets)
    for n, a in enumerate(known):
        for b in known[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def text_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for _ in range(25):  # families around a centre: members are close to it, but often not to each other
        base = text_of(rng, rng.choice([6, 12, 60, 300]))
        family = [" ".join(base)]
        for _ in range(rng.randrange(8)):
            other = list(base)
            for _ in range(rng.randrange(1, 3)):
                other[rng.randrange(len(other))] = f"v{rng.randrange(9999)}"
            family.append(" ".join(other).upper() if rng.random() < 0.2 else "  ".join(other))
        out += family
    chain = text_of(rng, 300)
    for k in range(12):  # a chain whose ends share little
        chain[k * 20 : k * 20 + 5] = text_of(rng, 5)
        out.append(" ".join(chain))
    out += ["one two three", "One two\tthree", "one two", "", "  \n", "a b c d e", "a b c d e", "a b c d e f g h i j k", "A b c d e f g h i j"]
    rng.shuffle(out)
    return list(enumerate(out, 100)) + [(7, None)]


@pytest.mark.parametrize("percent", [80, 85])
def test_like_brute_force(spark, rows, percent):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in minhash.classes(docs, percent).collect()}
    sets = brute_sets(rows)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_classes(rows, percent)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_copies_nulls_repeated_rows_and_empty_table(spark):
    text = "the same words again and again in many copies of this text"
    rows = [(i, text) for i in range(500, 100, -1)] + [(None, text), (None, None), (100, "other"), (100, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.classes(docs, 80).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id and r.doc_id > 100} == {101}
    assert [r.component_id for r in got if r.doc_id is None] == [None, None] and all(r.kept for r in got if r.doc_id is None)
    assert [r.kept for r in got if r.doc_id == 100] == [True, True]
    assert minhash.classes(docs.limit(0), 80).count() == 0


def test_borrowing_bins_estimate_similarity():
    rng = np.random.default_rng(5)
    for n in (8, 30, 400):
        same = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n // 4 :])
            same.append((minhash.signature(a) == minhash.signature(b)).mean())
        wanted = (n - n // 4) / (n + n // 4)
        assert abs(np.mean(same) - wanted) < 0.06


def test_star_edges_bound_the_candidates(spark):
    # many versions of one text: far fewer candidates than pairs
    rng = random.Random(9)
    base = text_of(rng, 400)
    rows = []
    for i in range(120):
        own = list(base)
        own[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = minhash.signatures(docs, 80).collect()
    buckets = {}
    for r in signed:
        for b in r.bands:
            buckets.setdefault(b, []).append(r.doc_id)
    stars = {(min(m), i) for m in buckets.values() for i in m if i != min(m)}
    assert len(stars) < 120 * 119 / 2 / 3
    assert {r.component_id for r in minhash.classes(docs, 80).collect()} == {0}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_large_family_is_dealt_once_to_an_outlier(spark):
    """Members of a bucket's largest class don't meet among themselves; all pairs of different classes meet in one place."""
    columns = "bucket long, rep long, class long, n long, profile binary"
    rows = [(1, k, 0, 9, b"") for k in range(5000)] + [(1, 6000, 6000, 9, b"")]
    rows += [(2, k, 10_000 + k % 3, 9, b"") for k in range(2000)] + [(3, k, 5, 9, b"") for k in range(50)]
    members = spark.createDataFrame(rows, columns)
    members = members.join(minhash.unsettled(members), "bucket")
    dealt = minhash.dealt(members).select("bucket", "i", "j", "rep", "class").toPandas()
    assert set(dealt.bucket) == {1, 2}
    first = dealt[dealt.bucket == 1]
    # the outlier goes to each block of the family and to its own
    assert len(first) == 5000 + -(-5000 // minhash.BLOCK_ROWS) + 1 and (first.groupby("rep").size().drop(6000) == 1).all()
    x, y = 667, 1333
    assert x + y <= (dealt.bucket == 2).sum() <= (2 * x + y) * y / minhash.BLOCK_ROWS + 4 * (x + y)
    places = {}
    for r in dealt.itertuples():
        if r.bucket == 2:
            places.setdefault((r.i, r.j), []).append((r.rep, r[5]))
    met = {(a, b) for held in places.values() for a, c in held for b, d in held if a < b and c != d}
    assert len(met) == 667 * 667 + 2 * 667 * 666


def test_links_across_classes_in_many_blocks(spark, monkeypatch):
    """With blocks of four rows the classes are those of brute force."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    random_state, base, rows = random.Random(11), [f"w{k}" for k in range(60)], []
    for k in range(120):
        words = list(base)
        for _ in range(random_state.randrange(5)):
            words[random_state.randrange(60)] = f"x{random_state.randrange(8)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.classes(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), 85).collect()}
    assert got == brute_classes(rows, 85)
