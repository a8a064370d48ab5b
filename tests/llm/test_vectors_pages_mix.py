"""Nearest neighbours, web archives and mixing against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from rateweave.llm import ann, mixing, warc

VECTORS = "vec_id long, embedding array<float>, vector string, score string"


def brute_nearest(vectors, queries, k):
    out = {}
    for i, q in queries:
        found = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), j) for j, v in vectors if j != i)
        out[i] = [(j, d) for d, j in found[:k]]
    return out


@pytest.mark.parametrize("block, queries_in_block", [(4096, 512), (64, 3)])
def test_neighbours_like_brute_force(spark, monkeypatch, block, queries_in_block):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "QUERY_ROWS", queries_in_block)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 24)) * 3
    rows = [(i, (centres[i % 20] + rng.standard_normal(24)).astype("f4").tolist()) for i in range(1500)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    asked = [r for r in rows if r[0] % 100 == 0]
    got = defaultdict(list)
    for r in ann.search(ann.build_index(df), df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    wanted = brute_nearest(rows, asked, 10)
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in w}) for i, w in wanted.items())
    assert hits >= 0.95 * 10 * len(asked)
    scores = {i: dict(brute_nearest(rows, [(i, q)], len(rows))[i]) for i, q in asked[:3]}
    for i in scores:
        assert all(abs(scores[i][j] - d) < 1e-12 for j, d in got[i])
    assert all(len(v) == 10 and v == sorted(v, key=lambda x: (x[1], x[0])) for v in got.values())


def test_ties_bad_vectors_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0])] + [(k, [1.0, 1.0]) for k in range(1, 40)] + [
        (100, [0.0, 0.0]), (101, None), (102, [nan, 1.0]), (103, [1.0, inf]), (104, [1.0, None]), (105, []), (106, [1.0, 2.0, 3.0]), (None, [1.0, 0.5]),
    ]
    df = spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)
    got = ann.search(ann.build_index(df), df.where("vec_id % 100 = 0"), 10).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, k, k, 1.0) for k in range(1, 11)]
    few = df.where("vec_id in (0, 5)")
    assert [(r.vec_id, r.score) for r in ann.search(ann.build_index(few), few.where("vec_id = 0"), 10).collect()] == [(5, 1.0)]
    none = df.limit(0)
    assert ann.search(ann.build_index(none), none, 10).count() == 0
    assert ann.search(ann.build_index(df), none, 10).count() == 0


def test_many_blocks_of_the_registered_vectors_are_searched_in_part(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 128)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    index, asked = ann.build_index(df), df.where("vec_id % 100 = 0")
    sizes = [r.rows for r in index.select("rows").collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 16 and max(sizes) <= 160
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    wanted = {i: {j for j, _ in near} for i, near in brute_nearest(rows, [r for r in rows if r[0] % 100 == 0], 10).items()}
    got = defaultdict(set)
    for r in ann.search(index, asked).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[i] & near) for i, near in wanted.items()) >= 0.9 * sum(map(len, wanted.values()))
    verified = ann.answers(index, asked, 11).groupBy("query_id").sum("verified").collect()
    share = sum(r[1] for r in verified) / len(verified) / 2000
    assert 0.02 < share < 0.9


def test_equal_vectors_repeated_ids_and_heavy_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    rows = [(k, [1.0, 2.0]) for k in range(1, 90)] + [(0, [1.0, 2.0])] * 2 + [(0, [4.0, 6.0]), (200, [9.0, 9.0]), (300, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)
    index = ann.build_index(df)
    assert max(r.rows for r in index.select("rows").collect()) <= 32
    got = defaultdict(list)
    for r in ann.search(index, df, 3).orderBy("query_id", "rank", "score").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    # either equal row of id 0 has the other as its nearest; the third row of that id asks for itself
    assert got[0] == [(1, 0, 0.0), (1, 0, 0.0), (1, 0, 5.0), (2, 1, 0.0), (2, 1, 0.0), (2, 0, 5.0), (3, 2, 0.0), (3, 2, 0.0), (3, 1, 5.0)]
    assert got[1] == [(1, 0, 0.0), (2, 0, 0.0), (3, 2, 0.0)] and got[50] == [(1, 0, 0.0), (2, 0, 0.0), (3, 1, 0.0)]
    assert got[200][0] == (1, 300, 0.0) and got[300][0] == (1, 200, 0.0) and len(got) == 92


def test_chi_square():
    assert abs(ann.chi_square_cdf(ann.chi_square_quantile(0.95, 8), 8) - 0.95) < 1e-9
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507313) < 1e-4


def test_incremental_search_stops_early():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 20
    points = np.vstack([c + rng.standard_normal((100, 16)) for c in centres])
    projected = points @ ann.projection(16)
    tree = ann.KdTree.over(projected)
    assert sorted(tree.order.tolist()) == list(range(4000))
    gaps = [gap for gap, _, _ in tree.leaves(projected[0])]
    assert gaps == sorted(gaps) and gaps[0] == 0
    limit = ann.chi_square_quantile(ann.CONFIDENCE, ann.PROJECTED)
    best = np.sort(((points - points[0]) ** 2).sum(axis=1))[10]
    assert sum(gap <= limit * best for gap in gaps) < 0.3 * len(gaps)


PAGES = "page_id long, url string, html string, digest string, key string"


def test_archives_and_two_level_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    big = "<p>é text</p>\r\n\r\n" * 90
    rows = [(i, f"http://h{i % 5}.example.com/p{i}?a=\t{i}", big if i % 3 == 0 else f"<p>{i}</p>" * (i % 40)) for i in range(60)]
    rows += [(70, None, None), (71, "http://a.b/", ""), (None, "http://x.y/z", big), (None, None, None), (72, "http://h0.example.com/p0?a=\t0", "again")]
    rows += [(57, "http://same.example/", big), (80, "odd\nurl", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(3)
    directory = warc.write_index(warc.write(pages))
    got = warc.read(directory).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            last[body] = max(last.get(body, -1), i)
    wanted = Counter()
    for i, url, html in rows:
        body = (html or "").encode()
        other = last.get(body)
        refers = other if other is not None and other != i and list(last).count(body) and sum((h or "").encode() == body for _, _, h in rows) > 1 else None
        wanted[i, (url or "").replace("\n", "%0A"), "revisit" if refers is not None else "response", refers, b"" if refers is not None else body] += 1
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload) for r in got) == wanted
    lookup = warc.Lookup(directory)
    assert len(lookup.keys) > 5 and directory.count() == len(lookup.keys)
    for i, url, html in rows[:20]:
        found = lookup.captures(url)
        assert {c[1] for c in found} == {j for j, u, _ in rows if u == url}
        headers, payload = lookup.record(next(c for c in found if c[1] == i))
        assert headers["WARC-Target-URI"] == url
        if headers["WARC-Type"] == "response":
            assert payload == (html or "").encode() and headers["WARC-Payload-Digest"] == warc.payload_digest(payload)
    assert lookup.captures("http://nowhere.example/") == []
    every = warc.find(directory, pages)
    assert Counter(map(tuple, every.collect())) == Counter(map(tuple, warc.index_captures(directory).collect()))
    some = pages.where("page_id % 3 = 0 or page_id is null")
    wanted = Counter((u, i) for i, u, _ in rows if i is None or i % 3 == 0)
    found = warc.find(directory, some.unionByName(some).unionByName(spark.createDataFrame([(10**9, rows[0][1]), (0, "http://nowhere.example/")], "page_id long, url string"), allowMissingColumns=True))
    assert Counter((r.key, r.page_id) for r in found.collect()) == Counter({k: n for k, n in Counter((warc.reversed_host_key(u), i) for (u, i) in wanted.elements()).items()})
    assert warc.find(directory, pages.limit(0)).count() == 0
    none = warc.write_index(warc.write(pages.limit(0)))
    assert warc.find(none, pages).count() == 0
    assert warc.read(none).count() == 0 and warc.Lookup(none).captures("http://a.b/") == []


def test_keys():
    assert warc.reversed_host_key("http://www.Example.com:80/A?b#c") == "com,example,www:80)/A?b"
    assert warc.reversed_host_key("https://a.b") == "b,a)/" and warc.reversed_host_key(None) == "-"


DOCS = "doc_id long, source string, text string, tokens string, weight string, bucket string"


def corpus():
    rows, i = [], 0
    for source, n in (("hot", 300), ("b", 60), ("c", 40), ("d", 9), (None, 20)):
        for k in range(n):
            rows.append((i, source, " ".join(["w"] * (1 + (k * 7) % 50))))
            i += 1
    return rows + [(i, "empty", ""), (i + 1, "empty", None), (0, "hot", "w"), (0, "hot", "w"), (None, "b", "some words here")]


def bisected(shares, entropy_share, max_repeats):
    def met(a):
        q = [p**a for p in shares]
        w = [x / sum(q) for x in q]
        repeats = [x / p for x, p in zip(w, shares)]
        return -sum(x * math.log(x) for x in w) <= entropy_share * math.log(len(w)) + 1e-12 and max(repeats) / min(repeats) <= max_repeats + 1e-12

    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (low, middle) if met(middle) else (middle, high)
    return high


@pytest.mark.parametrize("bucket_rows", [20_000, 16])
def test_mix_meets_its_targets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(4)
    got = mixing.mix(docs, 0.9, 3.0, block_tokens=500).collect()
    tokens = Counter()
    for _, source, text in rows:
        tokens[source] += len((text or "").split())
    total = sum(tokens.values())
    known = [s for s in tokens if tokens[s]]
    a = bisected([tokens[s] / total for s in known], 0.9, 3.0)
    q = {s: (tokens[s] / total) ** a for s in known}
    weights = {s: q[s] / sum(q.values()) for s in known}
    budget = max(tokens[s] / weights[s] for s in known)
    drawn, streams = Counter(), defaultdict(list)
    for r in got:
        drawn[r.source] += r.tokens
        streams[r.source, r["pass"]].append(r)
        if r.source in weights:
            assert abs(r.weight - weights[r.source]) < 1e-6
    for s in known:  # to within the last document of the stream
        assert 0 <= drawn[s] - round(weights[s] * budget) + 1e-3 * budget * 0 + 1 <= 52, s
    # nothing is left out, every full pass is a permutation, passes differ in order
    assert Counter((r.doc_id, r.source) for r in got if r["pass"] == 1) == Counter((i, s) for i, s, _ in rows)
    full = [k for k in streams if (k[0], k[1] + 1) in streams]
    assert full
    for s, n in full:
        assert Counter(r.doc_id for r in streams[s, n]) == Counter(i for i, t, _ in rows if t == s)
        if len(streams[s, n]) == len(streams[s, 1]) > 5 and n > 1:
            order = lambda rs: [r.doc_id for r in sorted(rs, key=lambda r: r.place)]
            assert order(streams[s, n]) != order(streams[s, 1])
    # each block but the last has the target weights, to within a document
    in_block = defaultdict(Counter)
    for r in got:
        in_block[r.block][r.source] += r.tokens
    for b in sorted(in_block)[:-2]:
        for s in known:
            assert abs(in_block[b][s] - weights[s] * 500) <= 52


def test_mix_small_cases(spark):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in corpus()], DOCS)
    assert mixing.mix(docs.limit(0)).count() == 0
    one = docs.where("source = 'd'")
    assert Counter(r.doc_id for r in mixing.mix(one).collect()) == Counter(r.doc_id for r in one.collect())
    assert mixing.mix(docs.where("source = 'empty'")).count() == 2
    drawn = Counter()
    for r in mixing.mix(docs, 0.9, 100.0, budget_tokens=2000).collect():
        drawn[r.source] += r.tokens
    assert 1900 < sum(drawn.values()) < 2400
    again = [tuple(r) for r in mixing.mix(docs, 0.9, 3.0).orderBy("block", "place").collect()]
    assert again == [tuple(r) for r in mixing.mix(docs.repartition(7), 0.9, 3.0).orderBy("block", "place").collect()]


def test_shares_too_even_for_the_entropy_limit_stay_as_they_are(spark):
    even = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "source string, tokens long")
    assert mixing.exponent(even, 0.95, 2.0) == 1.0
    docs = spark.createDataFrame([(k, "abc"[k % 3], "five words in each text") for k in range(30)], "doc_id long, source string, text string")
    got = mixing.mix(docs, entropy_share=0.95).collect()
    assert sorted(r.doc_id for r in got) == list(range(30)) and all(abs(r.weight - 1 / 3) < 1e-12 for r in got)
