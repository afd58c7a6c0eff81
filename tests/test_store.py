"""The segmented index against a plain BM25 over the documents that are there."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import store
from corpusmill.operators.store import Store

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
SCHEMA = "doc_id long, text string"


def text_of(rng, n):
    return " ".join(WORDS[min(399, int(rng.paretovariate(0.5)) - 1)] for _ in range(n))


def plain(docs, queries, n):
    """{(q, rank): (id, score)} by the formula, over {id: text}."""
    tf = {i: collections.Counter((t or "").split()) for i, t in docs.items()}
    size = {i: max(1, sum(c.values())) for i, c in tf.items()}
    avg = sum(size.values()) / len(size) if size else 1.0
    df = collections.Counter(w for c in tf.values() for w in c)
    out = {}
    for q, text in queries:
        scores = {}
        for w in set(text.split()):
            idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
            for i, c in tf.items():
                if c[w]:
                    scores[i] = scores.get(i, 0) + idf * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size[i] / avg))
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:n], 1):
            out[q, rank] = (i, round(s, 6))
    return out


def found(s, q, n):
    return {(r.q, r["rank"]): (r.id, round(r.bm25, 6)) for r in s.search(q, n).collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(store, "BLOCK_DOCS", 8)
    monkeypatch.setattr(store, "FIRST_BLOCKS", 2)


def test_search_equals_plain_scores_and_leaves_blocks_out(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    docs = {i: text_of(rng, rng.randint(1, 60)) for i in range(600)} | {600: None, 601: ""}
    queries = [(q, text_of(rng, 5)) for q in range(12)] + [(12, "nowhere"), (13, " ".join(WORDS[:40]))]
    s = Store(spark, f"file://{tmp_path}/s")
    s.add(spark.createDataFrame(list(docs.items()) + [(None, "wa"), (3, docs[3]), (3, "")], SCHEMA))
    q = spark.createDataFrame(queries, "q long, text string")
    assert found(s, q, 5) == plain(docs, queries, 5)
    rare = spark.createDataFrame([(0, f"{WORDS[150]} {WORDS[0]} {WORDS[1]}")], "q long, text string")
    read, every = s.shares(rare, 1)
    assert 0 < read < 0.5 * every


def test_segments_tombstones_and_merges_equal_a_new_index(spark, tmp_path, small_blocks):
    rng = random.Random(2)
    s, docs = Store(spark, f"file://{tmp_path}/s"), {}
    queries = [(q, text_of(rng, 4)) for q in range(6)]
    q = spark.createDataFrame(queries, "q long, text string")
    assert found(s, q, 3) == {}
    for step in range(4):
        part = {rng.randrange(150): text_of(rng, rng.randint(1, 30)) for _ in range(25)}
        before = {x: spark.read.parquet(f"{s.root}/documents/{x}").inputFiles() for x in s.segments()}
        s.add(spark.createDataFrame(list(part.items()), SCHEMA))
        docs |= part
        gone = [i for i in docs if i % 11 == step]
        s.remove(spark.createDataFrame([(i,) for i in [*gone, 9999]], "id long"))
        docs = {i: t for i, t in docs.items() if i not in gone}
        # older segments are never rewritten
        assert all(spark.read.parquet(f"{s.root}/documents/{x}").inputFiles() == files for x, files in before.items())
        assert found(s, q, 4) == plain(docs, queries, 4), step
        assert {r.id for r in s.documents().select("id").collect()} == set(docs)
    assert len(s.segments()) < 4  # tiers were merged
    new = Store(spark, f"file://{tmp_path}/new")
    new.add(spark.createDataFrame(list(docs.items()), SCHEMA))
    s.merge()
    assert len(s.segments()) == 1 and found(s, q, 4) == found(new, q, 4)
    assert {r.term: r.df for r in s.frequencies().collect()} == {r.term: r.df for r in new.frequencies().collect()}


def test_a_version_without_its_end_is_not_read(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.add(spark.createDataFrame([(1, "alpha beta")], SCHEMA))
    (tmp_path / "s/manifests/2").mkdir()
    assert len(s.segments()) == 1
    s.remove(spark.createDataFrame([(1,)], "id long"))
    assert s.documents().count() == 0 and s.statistics().first().n == 1 and s.frequencies().count() == 0
    assert s.search(spark.createDataFrame([(0, "alpha")], "q long, text string"), 3).count() == 0


def test_postings_are_made_and_scored_where_documents_stand(spark, tmp_path, small_blocks):
    rng = random.Random(5)
    docs = {i: text_of(rng, rng.randint(1, 40)) for i in range(400)}
    s = Store(spark, f"file://{tmp_path}/s")
    s.add(spark.createDataFrame(list(docs.items()), SCHEMA))
    p = spark.read.parquet(f"{s.root}/postings/{s.segments()[0]}")
    # all entries of a document are in one file, under one block of few documents
    spread = p.select(F.input_file_name().alias("file"), "block", F.explode("entries.id").alias("id"))
    assert spread.groupBy("id").agg(F.countDistinct("file", "block").alias("n")).where("n > 1").count() == 0
    assert spread.groupBy("block").agg(F.countDistinct("id").alias("n")).agg(F.max("n")).first()[0] <= store.BLOCK_DOCS
    assert p.agg(F.sum(F.size("entries"))).first()[0] == s.documents().agg(F.sum(F.size("terms"))).first()[0]
    queries = [(q, text_of(rng, 6)) for q in range(5)]
    assert found(s, spark.createDataFrame(queries, "q long, text string"), 4) == plain(docs, queries, 4)


def test_tombstones_are_one_row_a_block_and_shuffled_paths_agree(spark, tmp_path, small_blocks, monkeypatch):
    rng = random.Random(7)
    s, docs = Store(spark, f"file://{tmp_path}/s"), {i: text_of(rng, rng.randint(1, 20)) for i in range(200)}
    s.add(spark.createDataFrame(list(docs.items()), SCHEMA).coalesce(1))
    s.remove(spark.createDataFrame([(i,) for i in range(0, 200, 2)], "id long"))
    docs = {i: t for i, t in docs.items() if i % 2}
    gone = s.manifest()[-1]["tombstones"]
    t = spark.read.parquet(f"{s.root}/tombstones/{gone}")
    assert t.count() <= spark.read.parquet(f"{s.root}/postings/{s.segments()[0]}").select("block").distinct().count() < 100
    queries = [(q, text_of(rng, 4)) for q in range(4)]
    q = spark.createDataFrame(queries, "q long, text string")
    assert found(s, q, 4) == plain(docs, queries, 4)
    monkeypatch.setattr(store, "DEAD_BLOCKS", 0)  # more blocks than may be broadcast
    s.add(spark.createDataFrame([(1, "wa wb"), (1, "wa wb wc"), (2, "wa")], SCHEMA))
    docs |= {1: "wa wb wc", 2: "wa"}
    assert found(s, q, 4) == plain(docs, queries, 4)
    assert {(r.id, len(r.terms)) for r in s.documents().collect()} == {(i, len(set(x.split()))) for i, x in docs.items()}


def test_texts_of_ids_that_do_not_repeat_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([(i, "wa") for i in range(50)], "id long, text string").write.parquet(f"{tmp_path}/d")
    once = store._one_an_id(spark.read.parquet(f"{tmp_path}/d"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    twice = spark.read.parquet(f"{tmp_path}/d").union(spark.createDataFrame([(3, "wa wb"), (3, "wc wb")], "id long, text string"))
    got = {(r.id, r.text) for r in store._one_an_id(twice).collect()}
    assert got == {(i, "wc wb" if i == 3 else "wa") for i in range(50)}
