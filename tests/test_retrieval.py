"""Retrieval operators against plain-Python simulators and invariants."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import index, retrieve, terminology
from corpusmill.operators.packing_text import packed
from corpusmill.operators.packing_text import pieces as pieces_of
from corpusmill.operators.packing_text import stem_and_items, tokens

SF = "/root/testdata/sf0.001"


def tokenize(s):
    return [t.lower() for t in re.findall(T.TOKEN, s) if t.lower() not in T.STOP]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def bm25(rows, query):
    n, toks = max(len(rows), 1), {i: tokenize(t or "") for i, t in rows}
    avg = sum(max(len(t), 1) for t in toks.values()) / n
    out = {}
    for term in set(tokenize(query)):
        df = sum(term in t for t in toks.values())
        for i, t in toks.items():
            if f := t.count(term):
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * max(len(t), 1) / avg))
    return out


def test_bm25_equals_simulation_and_stored_tables(spark, docs):
    extra = spark.createDataFrame([(10_000, None), (10_001, "")], "doc_id long, text string")
    d = docs.select("doc_id", "text").unionByName(extra)
    rows = [tuple(r) for r in d.collect()]
    queries = [(0, "worthless erthan of the onand"), (1, "8 CFR 214.2 (f) zebra"), (2, "the of")]
    q = spark.createDataFrame(queries, "q long, text string")
    got = {(r.q, r.id): r.bm25 for r in index.bm25(d, q).collect()}
    want = {(k, i): s for k, t in queries for i, s in bm25(rows, t).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    stored = {(r.q, r.id): r.bm25 for r in index.bm25_indexed(index.build(d), q).collect()}
    assert stored.keys() == want.keys() and all(abs(stored[k] - want[k]) < 1e-9 for k in want)
    shuffled = {(r.q, r.id): r.bm25 for r in index.bm25(d.repartition(7, "text"), q).collect()}
    assert all(abs(got[k] - shuffled[k]) < 1e-9 for k in want)


def test_copies_of_a_document_tie_and_rank_by_id(spark):
    terms = "alpha beta gamma delta omega sigma kappa lambda"
    texts = [terms, "alpha alpha gamma omega kappa", "beta delta delta sigma", "gamma sigma alpha lambda beta", "nothing"]
    rows = [(i, texts[i % len(texts)] + " filler" * (i % len(texts))) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(9, "text", "doc_id")
    q = spark.createDataFrame([(0, terms)], "q long, text string")
    for scores in (index.bm25(d, q), index.bm25_indexed(index.build(d), q)):
        got = {r.id: r.bm25 for r in scores.collect()}
        assert len({(i % len(texts), s) for i, s in got.items()}) == len(texts) - 1
    best = max(range(len(texts) - 1), key=lambda k: got[k])
    ranked = retrieve.top(index.bm25(d, q), "bm25", 96).orderBy("rank").collect()
    assert [r.id for r in ranked] == [i for i, _ in rows if i % len(texts) == best][:96]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Tables in which each matching document has many copies, read by Spark and by DuckDB on one thread."""
    import duckdb

    from corpusmill.plans import queries_retrieval

    rng, path = random.Random(2), tmp_path_factory.mktemp("copies")
    words = queries_retrieval.QUESTION.split()
    texts = [" ".join(rng.choices(words, k=rng.randint(4, 12)) + ["filler"] * k) for k in range(8)] + ["nothing", "filler"]
    rows = [(i, texts[i % len(texts)], "en", f"src{i % 97}") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(9).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 1500, 2)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(100_000 + i if i else 0, [float(i % 7), 1.0]) for i in range(90)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect(config={"threads": 1})
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return str(path), con


def _as_sql(spark, copies, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, copies[0])
    want = copies[1].sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_tier_weighted_rank_of_copies_is_that_of_sql(spark, copies):
    _as_sql(spark, copies, "tier_weighted_rank")


def test_usable_limit_of_copies_is_that_of_sql(spark, copies):
    _as_sql(spark, copies, "usable_limit")


def test_empty_corpus(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    s = index.build(d).corpus_stats.first()
    assert (s.n, s.avglen) == (1, 1.0)


def test_tokens_keep_citation_parts():
    assert tokenize("8 CFR 214.2(f)(5) What is D/S?") == ["8", "cfr", "214.2", "(f)", "(5)", "d", "s"]


def test_dense_pool_is_exact(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    q = np.array([rows[3].embedding, rows[5].embedding], np.float64)
    got = {}
    for r in retrieve.dense_top(e.repartition(5), q, 7).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    for k in (0, 1):
        score = sorted(((-float(np.dot(np.array(r.embedding, np.float64), q[k])), r.vec_id) for r in rows))
        assert [i for _, i in sorted(got[k])] == [i for _, i in score[:7]]


def greedy(rows, k, per_citation, per_section):
    cites, sections, out, usable = {}, {}, [], 0
    for i, c, s, score, ok in sorted(rows, key=lambda r: (-r[3], r[0])):
        if usable == k:
            break
        if cites.get(c, 0) < per_citation and sections.get(s, 0) < per_section:
            cites[c], sections[s] = cites.get(c, 0) + 1, sections.get(s, 0) + 1
            out.append(i)
            usable += ok
    return out


def test_caps_equal_a_greedy_pass(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for q in range(40):
        own = []
        for i in range(rng.randint(0, 40)):
            c = rng.randint(0, 8)
            own.append((i, f"c{c}", f"s{c // 3}", rng.randint(0, 12) / 4, rng.random() > 0.2))
        want[q] = greedy(own, 6, 2, 4)
        rows += [(q, *r) for r in own]
    df = spark.createDataFrame(rows, "q long, id long, citation string, section string, score double, usable boolean")
    got = {q: [] for q in range(40)}
    for r in retrieve.cut_usable(retrieve.double_cap(df, 2, 4), 6).collect():
        got[r.q].append((r["rank"], r.id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == want


def test_fusion_adds_absent_sides_as_nothing(spark):
    d = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "q long, id long, rank long")
    x = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "q long, id long, rank long")
    got = {r.id: r.fused for r in retrieve.fuse(d, x).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})


@pytest.mark.parametrize(("citation", "prefix", "expected"), [("Ch 2", "Ch 2", True), ("Ch 20", "Ch 2", False), ("Ch 4, B", "Ch 4", True), ("Ch 4, BB", "Ch 4, B", False), ("Ch 4, B.1", "Ch 4, B", True), ("8 CFR § 214.2(f)", "8 CFR § 214.2", True)])
def test_under(spark, citation, prefix, expected):
    assert spark.range(1).select(retrieve.under(F.lit(citation), F.lit(prefix)).alias("x")).first().x is expected


def test_gate_is_inclusive(spark):
    rows = spark.createDataFrame([(0, 0.62), (1, 0.6199), (1, 0.1)], "q long, cosine double")
    assert {r.q: r.passes for r in retrieve.gate(rows).collect()} == {0: True, 1: False}


def test_merge_keeps_the_questions_share_and_never_exceeds_k(spark):
    rng = random.Random(2)
    rows = []
    for question in range(12):
        for qi in range(4):
            for rank in range(1, 13):
                c = rng.randint(0, 30)
                rows.append((question, qi, rank, rng.randint(0, 10_000), f"8 CFR § {c // 4}.{c}", f"text {rng.randint(0, 200)}", 1.0, rng.random() > 0.1))
    df = spark.createDataFrame(rows, "question_id long, qi int, rank long, id long, citation string, text string, score double, usable boolean")
    for k in (1, 5, 12):
        out = retrieve.merge_slates(df, k).collect()
        for question in range(12):
            mine = [r for r in out if r.question_id == question]
            assert sum(r.usable for r in mine) <= k
            assert len({(r.citation, r.id) for r in mine}) == len(mine)
            first = [r for r in mine if r.qi == 0]
            assert len(first) >= 1
            per = {}
            for r in mine:
                per[r.citation] = per.get(r.citation, 0) + 1
            assert max(per.values()) <= max(3, k)


def test_expansion_is_idempotent_and_columns_equal_strings(spark):
    rows = ["Can I do CPT before OPT?", "opt for it", "EB-1 and EB-1A, EB1C", "D/S and I-94", "O-1A or NIW with RFEs", ""]
    df = spark.createDataFrame([(r,) for r in rows], "q string")
    got = [r[0] for r in df.select(terminology.expand(F.col("q"))).collect()]
    assert got == [terminology.expand_text(r) for r in rows]
    assert [terminology.expand_text(g) for g in got] == got


def test_scopes_set_aside(spark):
    rows = {"my EB-1A evidence": ["8 CFR § 214.2(o)", "USCIS PM Vol 2, Pt M"], "EB-1A or O-1": [], "an F-1 student": 12, "nothing": []}
    for q, want in rows.items():
        got = spark.range(1).select(terminology.excluded(F.lit(q)).alias("x")).first().x
        assert len(got) == want if isinstance(want, int) else got == want


# --- packing --------------------------------------------------------------------------


def test_pack_keeps_order_budget_and_overlap():
    rng = random.Random(4)
    for _ in range(80):
        paras = [" ".join(f"w{k}_{i}" for i in range(rng.randint(1, 60))) + "." for k in range(rng.randint(0, 25))]
        pieces = pieces_of(paras, 60, 15)
        seen = [w for p in pieces for w in p.split()]
        assert set(seen) == {w for p in paras for w in p.split()}
        firsts = [paras.index(next(p for p in paras if x.startswith(p[:4]))) for x in pieces] if pieces else []
        assert firsts == sorted(firsts)


def test_oversized_paragraph_is_cut_at_sentences():
    big = " ".join(f"Sentence number {i} has a few words." for i in range(60))
    pieces = pieces_of(["Short one.", big, "Last one."], 60, 10)
    assert pieces[0] == "Short one." and all(tokens(p) <= 60 for p in pieces[:-1])


def split_up(spark, texts):
    """(served, embedded) of each part of each text."""
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", stem_and_items(F.col("t")).alias("p")).orderBy("i").collect()
    return [[tuple(x) for x in r.p] for r in got]


def test_enumerated_split(spark):
    stem = "8 CFR § 204.5(h) — Title\n" + "An alien must show at least three of the following: " + "filler words here " * 100
    text = stem + " ".join(f"({r}) Item {r} with its own words." for r in ("i", "ii", "iii", "iv"))
    out, short = split_up(spark, [text, "(i) A (ii) B"])
    assert len(out) == 5 and out[0][0].startswith("8 CFR")
    assert out[2][1] == "(ii) Item ii with its own words." and out[2][0].endswith(out[2][1]) and out[2][0].startswith("8 CFR § 204.5(h) — Title")
    assert short == [("(i) A (ii) B", "(i) A (ii) B")]


def test_enumerated_parts_make_up_the_text(spark):
    rng = random.Random(6)
    numerals = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
    made = [("", [], ""), ("", ["(i) A", "(ii) B"], ""), ("no items at all " * 200, [], "")]
    for _ in range(40):
        head = rng.choice(["8 CFR § 1.2(a) — T\n", "SEC. 4\n", "plain line\n", "", "8 U.S.C. § 9"])
        stem = head + " ".join(f"w{i}" for i in range(rng.choice([0, 3, 90, 300]))) + rng.choice([" ", "\n", ""])
        made.append((stem, [f"({r}) Item {r} " + "and words " * rng.randint(0, 60) for r in numerals[: rng.randint(2, 10)]], head))
    for (stem, items, head), parts in zip(made, split_up(spark, [s + " ".join(i) for s, i, _ in made])):
        text, items = stem + " ".join(items), [i.strip() for i in items]
        apart = len(items) >= 4 and int(len(text.split()) * 1.33) >= 400 and stem.strip()
        if not apart:
            assert parts == [(text, text)]
            continue
        assert parts[0] == (stem.rstrip(), stem.rstrip()) and [e for _, e in parts[1:]] == items
        cites = "§" in stem.split("\n")[0] or "SEC." in stem.split("\n")[0]
        line = stem.split("\n")[0].rstrip() if cites else ""
        last = (stem.partition("\n")[2] if cites else stem).split()[-120:]
        assert [s for s, _ in parts[1:]] == [" ".join(x for x in (line, " ".join(last), i) if x) for i in items]


def test_pieces_against_a_running_sum():
    """The ranges of the prefix sums are those of adding unit by unit."""
    from corpusmill.operators.packing_text import _fitting

    rng = random.Random(9)
    for _ in range(300):
        costs = [rng.choice([0, 1, 5, 20, 70]) for _ in range(rng.randint(0, 15))]
        overlap = rng.choice([0, 1, 10, 40])
        want, lo, new = [], 0, 0
        while new < len(costs):
            hi, used = new + 1, sum(costs[lo : new + 1])
            while hi < len(costs) and used + costs[hi] <= 60:
                used += costs[hi]
                hi += 1
            want.append((lo, hi))
            new = back = hi
            if overlap:
                back = hi - 1
                while back > lo and sum(costs[back:hi]) < overlap:
                    back -= 1
            lo = back
        assert list(_fitting(costs, 60, overlap)) == want


def test_block_searches_take_few_pairs_at_a_time(spark, monkeypatch):
    from corpusmill.operators import retrieve as R

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        v = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(300)], "vec_id long, embedding array<float>")
        found = R.dense_top_blocks(v, v.where("vec_id % 20 = 0"), 2, 2)
        assert found.count() == 2 * 15
        # a pair of full matrices of 64 dimensions and its scores stay within a few batches
        assert int(spark.conf.get(key).rstrip("b")) <= 8 << 20 and R.CHUNK * R.BLOCK * 8 <= 8 << 20
    finally:
        spark.conf.set(key, before)


def test_best_of_each_task_equal_the_best_of_all_scores(spark, docs, tmp_path, monkeypatch):
    from corpusmill.operators import retrieve as R

    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000, None), (10_001, ""), (None, "the erthan")], "doc_id long, text string"))
    d = d.unionByName(d.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 50_000)).repartition(5)  # copies tie, and rank by id
    q = spark.createDataFrame([(7, "worthless erthan of the onand"), (3, "8 CFR 214.2 (f) zebra"), (2, "the of")] + [(20 + r.doc_id, r.text[:200]) for r in docs.limit(9).collect()], "q long, text string")
    rows = lambda x: sorted((r.q, r["rank"], r.id, round(r.bm25, 9)) for r in R.top(x, "by", 4).collect())
    want = rows(index.bm25(d.where("doc_id is not null"), q).withColumn("by", F.round("bm25", 9)))
    whole = d.where("doc_id is not null")
    stored = index.stored(whole, f"file://{tmp_path}/i")
    found = index.bm25_best(whole, q, 4)
    assert rows(found) == want and rows(index.bm25_best_indexed(stored, q, 4)) == want
    # four rows a query and task at most leave the scan
    assert found.count() <= 4 * q.count() * max(found.rdd.getNumPartitions(), whole.rdd.getNumPartitions())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")  # documents that go over several batches
    assert rows(index.bm25_best(whole, q, 4)) == want
    spark.conf.set(key, before)
    monkeypatch.setattr(index, "BROADCAST_ROWS", 1)
    assert rows(index.bm25_best(whole, q, 4)) == want and rows(index.bm25_best_indexed(stored, q, 4)) == want
    assert index.bm25_best(whole.limit(0), q, 4).count() == 0


def test_a_split_makes_its_pairs_once(spark):
    docs = spark.createDataFrame([(1, ["one (i) piece"]), (2, []), (3, None), (4, [" "])], "doc_id long, paragraphs array<string>")
    got = packed(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1
    assert [(r.id, r.piece, r.text, r.embed_text) for r in got.collect()] == [(1, 0, "one (i) piece", "")]


def test_words_are_counted_and_taken_from_the_ends_as_split_has_them(spark):
    texts = ["", "  ", "a", " a\tb\n", "a\x0bb c d", "é ü x  ß\r\n", "w " * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (2, 3, 50, 51):
        for r in rows.select("t", T.words(F.col("t")).alias("w"), T.at_least_words(F.col("t"), n).alias("many"), T.last_words(F.col("t"), n).alias("last")).collect():
            assert r.many == (len(r.w) >= n) and r.last == " ".join(r.w[-n:]), (n, r.t)
