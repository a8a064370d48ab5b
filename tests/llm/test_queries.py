"""Registered queries against their SQL twins, and the pipeline against its stages taken by hand."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from rateweave.llm import catalog, minhash, mixing, quality, toxicity
from tests.llm.test_minhash import brute_classes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "labels", "benchmark"):
        db.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return db


def rounded(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_like_the_twin(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    twin = duck.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert Counter(map(rounded, got.select(*columns).collect())) == Counter(map(rounded, twin))


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


def test_recall_of_the_registered_search(spark, duck):
    got = {(r.query_id, r.vec_id) for r in catalog.op6_ann(spark, DATA).collect()}
    wanted = duck.execute(
        "select q, v from (select a.vec_id q, b.vec_id v, row_number() over (partition by a.vec_id order by "
        "list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) r from embeddings a join embeddings b "
        "on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) where r <= 10"
    ).fetchall()
    assert len(got & set(wanted)) >= 0.9 * len(wanted)


def test_pipeline_stage_by_stage(spark):
    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, before = {}, raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, DATA)
        assert before.columns == raw.columns and before.dtypes == raw.dtypes
        kept[name] = [tuple(r) for r in before.collect()]
    raw = raw.collect()
    text = {r.doc_id: r.text for r in raw}

    labels = spark.read.parquet(f"{DATA}/labels.parquet").withColumnRenamed("toxic", "label")
    rated = toxicity.rated(spark.read.parquet(f"{DATA}/documents.parquet"), labels).where("not rejected")
    after = {r.doc_id for r in rated.collect()}
    assert {r[0] for r in kept["toxicity"]} == after and all(r[1] == text[r[0]] for r in kept["toxicity"])

    judged = {i: quality.judge(text[i], quality.Rules()) for i in after}
    assert {r[0]: r[1] for r in kept["quality"]} == {i: j[0] for i, j in judged.items() if j[-1]}

    rows = [(r[0], r[1]) for r in kept["quality"]]
    classes = brute_classes(rows, 80)
    assert Counter(r[0] for r in kept["near_duplicates"]) == Counter({i for i, c in classes.items() if i == c})

    source = {r[0]: r[3] for r in kept["near_duplicates"]}
    times = Counter(r[0] for r in kept["mixing"])
    assert set(times) == set(source) and max(times.values()) <= 3
    mixed = mixing.mix(spark.createDataFrame(kept["near_duplicates"], before.schema), entropy_share=0.95, max_repeats=2.0)
    assert times == Counter(r.doc_id for r in mixed.collect())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    clean = {r[0]: r[1] for r in kept["mixing"]}
    last = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(r.doc_id for r in last) == times
    for r in last[:60]:
        ids = library.encode(clean[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.token_ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.n_tokens == len(ids)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nulls_and_empty_tables(spark, stage):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "text", "en", "s", 4), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "word " * 60, "en", "s", 300)]
    name, step = corpus_pipeline.STAGES[stage]
    out = step(spark, spark.createDataFrame(rows, schema), DATA).collect()
    assert (name == "quality") or len(out) >= 4
    assert step(spark, spark.createDataFrame([], schema), DATA).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_with_clashing_names(spark, stage):
    names = ["kept", "severity", "rejected", "clean_text", "times", "copy", "bucket", "pass", "weight", "label", "class", "place", "tokens"]
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(70)) + ".", "en", f"s{k % 2}", 1, *[f"{n}{k}" for n in names]) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, DATA)
    assert out.columns == docs.columns
    got = {tuple(r[5:]) for r in out.collect()}
    assert got == {tuple(r[5:]) for r in rows}


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    words = " ".join(f"word{k}" for k in range(80))
    rows = [(5, words, "en", "s", 1)] * 3 + [(6, words + " more", "en", "s", 1), (7, "other text of its own", "en", "s", 1)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), DATA).collect()
    assert sorted(r.doc_id for r in out) == [5, 7]
    assert minhash.WORDS == 5


def test_encoding_queries_like_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    wanted, files, start = {}, {}, 0
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted[r.doc_id] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        files[r.doc_id] = (start, len(ids) + 1, zlib.crc32(packed + (1).to_bytes(4, "little")))
        start += len(ids) + 1
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.op1_bpe(spark, DATA).collect()} == wanted
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in catalog.op3_token_files(spark, DATA).collect()} == files
