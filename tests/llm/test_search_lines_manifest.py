"""Ranked search, line dedup and the Merkle manifest against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateweave.llm import line_dedup, merkle, ranked_search

WORDS = [f"w{k}" for k in range(60)]


# --- ranked search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute_ranks(docs, items, best):
    found = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERM.findall(lower(t or "")))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c
            )
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows, block_terms, leaf", [(8192, 8192, 16), (40, 12, 2)])
def test_ranks_like_brute_force(spark, monkeypatch, block_rows, block_terms, leaf):
    monkeypatch.setattr(ranked_search, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 30), p=np.arange(1, 61) / 1830)) for _ in range(300)]
    texts += ["Über w1 ÜBER w2_w3-W4"] * 40 + [None, "", " .,- ", "w59 " * 5000]
    docs = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(3, texts[3], "x", 1), (7, "w1 w2", "x", 1), (None, "w1 w1 w5", "x", 1)]
    items = [(1, "W1 w2, w3!", 0), (2, "Über w59", 0), (2, "w7", 0), (3, None, 0), (4, "", 0), (5, "nowhere", 0), (None, "w1", 0)]
    items += [(10 + k, " ".join(rng.choice(WORDS, 8)), 0) for k in range(6)]
    got = ranked_search.search(
        spark.createDataFrame(docs, "doc_id long, text string, score string, n long"),
        spark.createDataFrame(items, "item_id long, text string, rank long"), best=20, block_rows=block_rows, block_terms=block_terms,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_ranks([d[:2] for d in docs], [i[:2] for i in items], 20)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(docs, items).count() == 0
    assert ranked_search.search(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)).count() == 0


def test_trees_leave_subtrees_out():
    rng = np.random.default_rng(6)
    topics = [rng.choice(400, 30, replace=False) for _ in range(40)]
    rows = [np.unique(rng.choice(topics[k % 40], 12)) for k in range(4000)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    term, value = np.concatenate(rows), rng.integers(1, 10**9, starts[-1])
    tree = ranked_search.BallTree(np.arange(4000), starts, term, value, 400)
    assert sorted(tree.ids) == list(range(4000))
    for topic in topics[:5]:
        query = np.sort(topic[:10])
        found, scored = tree.search(query, 10)
        exact = np.bincount(np.repeat(np.arange(4000), np.diff(starts)), np.where(np.isin(term, query), value, 0))
        wanted = sorted(((int(s), -i) for i, s in enumerate(exact) if s > 0), reverse=True)[:10]
        assert sorted(found, reverse=True) == wanted
        assert scored < 0.5 * 4000


# --- line dedup --------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def brute_lines(docs, least_points=20, least_documents=3):
    key = lambda line: lower(line.strip(BLANKS))
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_points:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < least_documents or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("filter_bits", [1 << 16, 1 << 26])
def test_lines_like_brute_force(spark, monkeypatch, filter_bits):
    monkeypatch.setattr(line_dedup, "GATHERED", 64)
    rng = np.random.default_rng(7)
    lines = [f"A line that  stands in many texts {k}" for k in range(30)] + ["short", "", "  \t ", "ééééééééééééééééééé", "éééééééééééééééééééé", "É" * 20]
    docs = [(k, "\n".join(rng.choice(lines, rng.integers(0, 12)))) for k in range(120)]
    docs += [(200 + k, f"only here, and nowhere else {k}\r\n  THE VERY COMMON LINE OF ALL\t\n\nthe very common line of all") for k in range(300)]
    docs += [(1, docs[1][1]), (1, "the very common line of all"), (600, None), (601, ""), (None, lines[0]), (None, "the very common line of all")]
    docs += [(602, "\n".join([lines[0]] * 3000)), (603, "x" * 200000), (604, "x" * 200000), (605, "X" * 200000 + "\x0b")]
    df = spark.createDataFrame([(*d, "mine", "keys") for d in docs], "doc_id long, text string, lost string, suspects string")
    got = line_dedup.dedup(df, filter_bits=filter_bits)
    assert got.columns == ["doc_id", "text", "lost", "suspects", "n_lines", "n_dropped", "kept_text"]
    rows = got.collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in rows) == brute_lines(docs)
    assert {(r.lost, r.suspects) for r in rows} == {("mine", "keys")}
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(docs)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_second_filter_holds_what_is_seen_twice(spark):
    docs = spark.createDataFrame(
        [(k, f"a line of its own, number {k}\nshared by two texts, pair {k // 2}") for k in range(2000)], "doc_id long, text string"
    ).repartition(4)
    twice = spark.sparkContext.broadcast(line_dedup.seen_twice(docs))
    assert len(twice.value) == line_dedup.FILTER_BITS // 8
    found = line_dedup.with_suspects(docs, twice, line_dedup.FILTER_BITS, 20).collect()
    for r in found:
        shared = hashlib.sha256(f"shared by two texts, pair {r.doc_id // 2}".encode()).digest()
        assert shared in [bytes(s) for s in r.suspects]
    assert sum(len(r.suspects) for r in found) < 2010  # hardly a line of its own is suspected


def test_filter_sizes():
    with pytest.raises(ValueError):
        line_dedup.seen_twice(None, filter_bits=100_000)


# --- Merkle manifest ---------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def grown(nodes):
    paths, below = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for k, run in enumerate(runs):
            for j in range(len(run)):
                for leaf in below[3 * k + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
        below = [sum(below[3 * k : 3 * k + 3], []) for k in range(len(runs))]
        nodes = [digest(*run) for run in runs]
    return nodes[0], paths


def brute_proofs(rows):
    trees = defaultdict(list)
    for i, text, lang, source, n in rows:
        hit = i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0
        leaf, held = (digest(*map(field, (i, source, lang, n, t))) for t in (text, text.replace("\n", "") if hit else text))
        trees[(source is not None, (source or "").encode())].append((i is not None, i or 0, leaf, held, i))
    own = [(sorted(trees[k], key=lambda x: x[:3]), *grown([x[2] for x in sorted(trees[k], key=lambda x: x[:3])])) for k in sorted(trees)]
    root, above = grown([subroot for _, subroot, _ in own])
    out = Counter()
    for (leaves, subroot, paths), up in zip(own, above):
        for (*_, leaf, held, i), path in zip(leaves, paths):
            node = held
            for before, after in path + up:
                node = digest(before, node, after)
            out[i, leaf, subroot, root, digest(*(b + a for b, a in path + up)), node, node == root] += 1
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, path string"
CASES = {
    "one row": [(1, "a\n", "l", "s", 1)],
    "nulls and repeats": [(1, "a\n", "l", None, 1)] * 2 + [(None, None, None, None, None), (None, "x", "y", "", 0), (2, "", "x", "", 0), (2, "\n", "x", "", 0)],
    "many": [(k, f"x\n{k}", "é", ["hot", "hot", "a", None, "ä"][k % 5], k) for k in range(500)] + [(3, "x" * 300000 + "\n", "l", "long", 1)],
}


@pytest.mark.parametrize("digits", [2, 5])
@pytest.mark.parametrize("case", CASES)
def test_proofs_like_brute_force(spark, case, digits):
    rows = CASES[case]
    docs = spark.createDataFrame([(*r, "t", "p") for r in rows], SCHEMA)
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.verified(docs, merkle.leaf_digest(text=cut), digits=digits)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")), "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == brute_proofs(rows)
    assert merkle.verified(docs, digits=digits).where("not verified").count() == 0


def test_manifest_of_an_empty_table(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).count() == 0
