"""Stages of the pipeline on ids with several texts, and on repeated rows."""

from collections import Counter

import corpus_pipeline
from rateweave.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(name, n=80):
    return " ".join(f"{name}{k}" for k in range(n))


def near_duplicates(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in texts]
    return sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect())


def test_only_the_duplicate_text_of_an_id_goes(spark):
    a, b, near = words("a"), words("b"), words("a") + " more"
    assert near_duplicates(spark, [(5, a), (5, b), (3, a)]) == [(3, a), (5, b)]
    assert near_duplicates(spark, [(5, near), (5, b), (3, a), (5, b), (9, b)]) == [(3, a), (5, b)]
    assert len(near_duplicates(spark, [(5, a), (5, near)])) == 1
    assert near_duplicates(spark, [(5, a), (5, b), (None, a), (None, b), (40, a)]) == [(0, a), (0, b), (5, a), (5, b)]


def test_of_rows_that_repeat_id_and_text_the_same_one_stays_in_any_order(spark):
    rows = [(3, words("a"), "en", source, n) for source, n in (("web", 5), ("books", 7), (None, 9), ("books", 2))] + [(4, None, None, None, None)] * 3
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, SCHEMA).repartition(3)
        assert sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())) == [(3, words("a"), "en", "books", 2), rows[-1]]
    none = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.drop_near_duplicates(spark, none, "").count() == 0


def test_the_mix_comes_in_its_order_of_blocks_with_every_repeated_row(spark):
    rows = [(k, words(f"t{k}x", 5 + k % 7), "en", "big" if k % 5 else "small", k) for k in range(120)]
    rows += [rows[0]] * 2 + [rows[1]] + [(None, "no id", "en", None, 1)] * 2 + [(7, "other text", "en", "big", 1), (7, "other text", "en", "small", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs, entropy_share=0.95, max_repeats=2.0).orderBy("block", "place").collect()
    got = corpus_pipeline.mix_sources(spark, docs, "")
    taken = got.collect()
    assert [(r.doc_id, r.source) for r in taken] == [(r.doc_id, r.source) for r in mixed]
    passes = Counter((r.doc_id, r.source, r["pass"]) for r in mixed)
    assert passes[0, "small", 1] == 3 and passes[None, None, 1] == 2 and max(passes.values()) == 3
    assert Counter(r.text for r in taken)[rows[0][1]] == sum(n for (i, *_), n in passes.items() if i == 0)
    assert set(map(tuple, taken)) == set(rows) and got.columns == docs.columns
