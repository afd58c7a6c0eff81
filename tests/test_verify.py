"""Answer checks, conversation windows and evaluation."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import conversation, evalkit, verify


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_citations(spark):
    answers = df(spark, [(1, "Under 8 CFR § 214.2(f)(5) and 9 CFR 3.1, see 8 CFR 204.5(h) and 8 U.S.C. § 1324a.", 2)], "id long, text string, n_sources int")
    slate = df(spark, [(1, "8 CFR § 214.2(f)", "text"), (1, "8 CFR § 204.50", "mentions 8 U.S.C. 1324a(b)")], "id long, citation string, text string")
    got = {(r.raw.split(" ")[0], r.problem) for r in verify.bad_citations(answers, slate).collect()}
    assert got == {("9", "wrong title"), ("8", "in no source")}  # 204.5 is not 204.50
    assert [r.n for r in verify.out_of_range(df(spark, [(1, "[1] [3] [0]", 2)], "id long, text string, n_sources int")).orderBy("n").collect()] == [0, 3]


def test_grounding_and_dialogue(spark):
    text = "You must file on time [1].\n\nYou may not work.\n- You can travel\n2. It is required that you wait [2]\nplain"
    got = verify.ungrounded(df(spark, [(1, text), (2, "Nothing stated.")], "id long, text string")).collect()
    assert [(r.id, r.n, r["first"]) for r in got] == [(1, 2, "You may not work.")]
    q = df(spark, [(1, "A?\n\nWhen did it end? Who filed?"), (2, "What? \n\nIs it so?"), (3, "")], "id long, text string")
    assert [(r.id, r.n) for r in verify.too_many_questions(q).collect()] == [(1, 2)]


def test_quotes(spark):
    sources = ["The student may remain in the country &amp; study for “four” years.", "A petition must be filed before the card expires; it is then pending."]
    src = df(spark, [(1, i, t) for i, t in enumerate(sources, 1)], "id long, source int, text string")
    raw = json.dumps({"answer": "a", "points": [
        {"source": 2, "quote": 'the student may remain in the country & study for "four" years', "applies": "to you"},
        {"source": 2, "quote": "A petition must be filed before the card expires; Nothing like this is in any source at all.", "applies": "x"},
        {"source": 1, "quote": "short", "applies": ""},
    ], "ask": ""})
    points = verify.quote_points(df(spark, [(1, raw), (2, "no json")], "id long, raw string"))
    got = {(r.point, r.part): r for r in verify.check_quotes(points, src).collect()}
    assert got[0, 0].kept and got[0, 0].moved and got[0, 0].source == 1 and got[0, 0].quote == "The student may remain in the country & study for “four” years"
    assert got[1, 0].kept and not got[1, 0].moved and got[1, 0].applies == "x"
    assert not got[1, 1].kept and got[1, 1].applies == "" and not got[2, 0].kept
    assert [r[0] for r in df(spark, [(raw,), ("prose",)], "raw string").select(verify.answer_text(F.col("raw"))).collect()] == ["a", "prose"]


def test_attributions(spark):
    rows = [
        (1, '{"attributions": [{"claim": 0, "source": 2}, {"claim": 1, "source": 64}, {"claim": 0, "source": 1}]}'),
        (2, '{"attributions": [{"claim": true, "source": 1}, {"claim": 2, "source": null}, {"claim": 9, "source": 1}]}'),
        (3, "not json"), (4, '{"attributions": {}}'), (5, '{"attributions": [{"claim": 1}]}'), (6, '{"attributions": [{"claim": 1.5, "source": 1}]}'),
    ]
    d = df(spark, [(i, r, 3, 5) for i, r in rows], "id long, raw string, n_claims int, n_sources int")
    assert {(r.id, r.claim, r.source) for r in verify.attributions(d).collect()} == {(1, 0, 2), (1, 1, None), (2, 2, None)}


def test_dates(spark):
    text = "File from 2027-02-14 on. The end is July 13, 2027.\n\nBy October 1, 2027 [1]. By 2026-10-01 [2]. Until 3/5/2028 and May 5, 2028."
    answers = df(spark, [(1, text, "finding: May 5, 2028")], "id long, text string, settled string")
    slate = df(spark, [(1, 1, "starts October 1, 2026"), (1, 2, "ends 10/1/2026"), (1, 3, "")], "id long, source int, served string")
    b = df(spark, [(1, 0, "opens", dt.date(2027, 2, 13)), (1, 1, "closes", dt.date(2027, 7, 13))], "id long, ord int, name string, d date")
    got = {r.raw: (r.verdict, r.boundary) for r in verify.check_dates(answers, slate, b).collect()}
    assert got == {
        "2027-02-14": ("drift", dt.date(2027, 2, 13)), "July 13, 2027": ("boundary", None), "October 1, 2027": ("derived", None), "2026-10-01": ("supported", None), "May 5, 2028": ("supported", None),
    }


def test_corpus_invariants(spark):
    p = df(spark, [("s", i, c, f"({c}) text" + (":" if c == "c" else "")) for i, c in enumerate("abxc")], "section string, ord int, letter string, text string")
    assert [(r.before, r.letter) for r in verify.sequence_breaks(p).orderBy("ord").collect()] == [("b", "x"), ("x", "c")]
    assert verify.unkept_promises(p).count() == 1
    q = df(spark, [("c1", "in force"), ("c1", "nowhere")], "citation string, quote string")
    assert [r.quote for r in verify.absent_quotes(q, df(spark, [("c1", "it is  in\nforce")], "citation string, text string")).collect()] == ["nowhere"]
    for cur, cand, ok in (("", "a", True), ("a", "b", True), ("z", "aa", True), ("aa", "bb", True), ("a", "c", False), ("h", "i", True), ("zz", "aaa", True)):
        assert spark.range(1).select(T.next_letter(F.lit(cur), F.lit(cand)).alias("x")).first().x is ok


def test_support(spark):
    c = df(spark, [(1, "students need authorization before working"), (2, "zebra quagga okapi")], "claim long, text string")
    s = df(spark, [(1, 7, "Some other words. Students need authorization before any working starts."), (1, 8, "zebra"), (2, 7, "students")], "claim long, source long, text string")
    got = {r.claim: (round(r.ratio, 3), r.flagged) for r in verify.support(c, s).collect()}
    assert got == {1: (1.0, False), 2: (0.0, True)}
    assert [r.source for r in verify.best_sources(c, s).where("claim = 1").orderBy("rank").collect()] == [7, 8]


CONV = "conv_id long, turn long, role string, text string"


def test_fold_system(spark):
    rows = [(1, 0, "system", "S1"), (1, 1, "assistant", "A0"), (1, 2, "user", "U1"), (1, 3, "assistant", "A1"), (1, 4, "user", "U2"), (1, 5, "system", "S2"), (2, 0, "user", "V")]
    got = [(r.conv_id, r.turn, r.role, r.text) for r in conversation.fold_system(df(spark, rows, CONV)).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 1, "assistant", "A0"), (1, 2, "user", "S1\n\nU1"), (1, 3, "assistant", "A1"), (1, 4, "user", "U2"), (1, 5, "user", "S2"), (2, 0, "user", "V")]


def test_history_and_budgets(spark):
    rows = [(1, i, "user", f"question {i} " + "w " * 10) for i in range(5)]
    h = conversation.history(df(spark, rows, CONV), 3, 40).first()
    assert h.kept == 2 and h.body.startswith("- question 3")
    assert conversation.history(df(spark, rows, CONV), 3, 1).first().kept == 1
    x = df(spark, [("a", 1, 5), ("a", 2, 50), ("a", 3, 1), ("b", 1, 99)], "k string, o int, c int")
    got = {(r.k, r.o) for r in conversation.fits(x, 10, "k", "o", F.col("c")).collect()}
    assert got == {("a", 1), ("b", 1)}  # no skipping ahead, and the first always stays
    c = conversation.condensed(df(spark, [(1, "One two three. Four five six. Seven eight.")], "id long, text string"), 7).first()
    assert c.text == "One two three. Four five six."


def test_prompt(spark):
    slate = df(spark, [(0, 1, "c1", "alpha beta", 1, 0.5), (0, 2, "c2", "", 7, 0.25), (0, 3, "c3", "w " * 100, 2, 0.1)], "q long, rank long, citation string, served string, tier int, cosine double")
    p = conversation.prompt(slate, 40).first()
    assert p.n_sources == 2 and "[2] c2\n(withheld: not in force)" in p.prompt
    from corpusmill.operators.retrieve import tier_table

    assert [(r.n, r.tier_name, r.cosine) for r in conversation.numbered(slate, tier_table(spark)).orderBy("n").collect()][:2] == [(1, "statute", "0.50"), (2, "unknown", "0.25")]
    more = df(spark, [(0, 0, "rule law")], "q long, ord long, citation string")
    assert conversation.labels(slate, more).orderBy("n").collect()[-1].n == 4


def test_with_previous(spark):
    rows = [(1, 0, "user", "A long question about the extension of status that stands on its own feet."), (1, 2, "user", "what if it is late?")]
    got = [r.query for r in conversation.with_previous(df(spark, rows, CONV)).orderBy("turn").collect()]
    assert got[1] == f"{rows[0][3]} what if it is late?" and got[0] == rows[0][3]


def test_evaluation(spark):
    a = df(spark, [(1, "You must\nfile"), (2, "no")], "id long, text string")
    checks = df(spark, [("files", "must.file", "must"), ("no no", "^no$", "must_not")], "name string, pattern string, kind string")
    m = evalkit.matrix(a, checks)
    assert {(r.id, r.name): r.passed for r in m.collect()} == {(1, "files"): True, (1, "no no"): True, (2, "files"): False, (2, "no no"): False}
    assert {r.name: (r.passes, r.score) for r in evalkit.tally(m, 2).collect()} == {"files": (1, 0), "no no": (1, 0)}  # half to even
    total = [r for r in evalkit.rollup(m, "kind").collect() if r.kind is None]
    assert (total[0].passes, total[0].checks) == (2, 4)
    r = evalkit.recall_precision(df(spark, [("U", True), ("U", False), ("S", True), ("N", True), ("X", False)], "label string, flagged boolean")).first()
    assert (r.tp, r.fp, r.u, r.miscited, r.recall, r.precision) == (1, 1, 2, 1, 0.5, 0.5)
    claims, labels = df(spark, [("h", 0), ("h", 1)], "slug string, ord int"), df(spark, [("h", "S U")], "slug string, letters string")
    assert {r.label for r in evalkit.labelled(claims, labels).collect()} == {"S", "U"} and evalkit.label_mismatches(claims, labels).count() == 0
    assert evalkit.label_mismatches(claims, df(spark, [("h", "S")], "slug string, letters string")).count() == 1


def test_quotes_of_any_length_are_found(spark):
    """Quotes of one word to many, cut inside words, against plain loops."""
    import random

    from corpusmill.operators import verify as V

    rng = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs = [(i if i % 6 else None, rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(7, None)]
    quotes = [(1, "beta gamma delta epsilon"), (2, "one two three"), (3, "alpha"), (4, "lpha bet"), (5, ""), (6, None), (7, "gamma delta eps"), (8, "a beta gamma d")]
    for i in range(9, 60):
        t = rng.choice([t for _, t in docs if t])
        a = rng.randrange(len(t))
        quotes.append((i, t[a : a + rng.randint(1, 40)]))
    got = {(r.quote_id, r.source_id) for r in V.containing(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(docs, "source_id int, text string")).collect()}
    assert got == {(q, d) for q, x in quotes for d, t in docs if x is not None and t is not None and x in t}
    one = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "one two three")], "source_id int, text string")
    assert {(r.quote_id, r.source_id) for r in V.containing(spark.createDataFrame(quotes[:2], "quote_id int, quote string"), one).collect()} == {(1, 1), (2, 2)}


def test_running_sums_over_ranges(spark):
    import random

    from corpusmill.plans.numbering import running

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    want, total = {}, {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    got = running(spark.createDataFrame(rows, "k string, i int, v int"), "v", ["i"], ["k"])
    assert {r.i: r.total for r in got.collect()} == want


def test_dense_search_leaves_out_what_has_no_score(spark):
    import numpy as np

    from corpusmill.operators import retrieve as R

    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    rows = good + [(None, [1.0] * 4), (60, None), (61, [1.0] * 3), (62, []), (63, [1.0, None, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    m = np.array([x for _, x in good])
    want = {(q, i) for q in range(0, 50, 20) for i in np.argsort(-(m @ m[q]), kind="stable")[:5].tolist()}
    got = R.dense_top_blocks(v, v.where("vec_id % 20 = 0"), 5, 4)
    assert {(r.q, r.id) for r in got.where("q < 50").collect()} == want
    assert {r.id for r in R.dense_top(v, m[:1], 50).collect()} == set(range(50))
    assert R.unscored(v, 4).count() == 5


def test_dense_search_of_many_groups_and_copies(spark):
    """1,300 groups and a null one; copies of a vector tie and rank by id in every block."""
    import numpy as np

    from corpusmill.operators import retrieve as R

    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 4))
    rows = [(i, base[0].tolist() if i % 3 else rng.normal(size=4).tolist(), None if i % 7 == 0 else f"g{i % 1300}") for i in range(5200)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, topic string").repartition(5)
    queries = v.where("vec_id in (0, 20, 2600)")
    got, want = {}, {}
    for r in R.dense_top_blocks(v, queries, 2, 4, group="topic").collect():
        got.setdefault((r.q, r.topic), []).append((r["rank"], r.id))
    for q in (0, 20, 2600):
        for i, x, g in rows:
            want.setdefault((q, g), []).append((-round(float(np.dot(x, rows[q][1])), 9), i))
    assert len(got) == 3 * 1301
    assert {k: [i for _, i in sorted(x)] for k, x in got.items()} == {k: [i for _, i in sorted(x)[:2]] for k, x in want.items()}
    alone = {q: [i for _, i in sorted(x for k, y in want.items() if k[0] == q for x in y)[:90]] for q in (0, 20, 2600)}
    for q, ids in alone.items():
        assert [r.id for r in R.dense_top_blocks(v, queries, 90, 4).where(f"q = {q}").orderBy("rank").collect()] == ids
    assert R.dense_top_blocks(v.where("vec_id < 0"), queries, 2, 4, group="topic").count() == 0
    assert R.dense_top_blocks(v, v.where("vec_id < 0"), 2, 4, group="topic").count() == 0


# --- best support -------------------------------------------------------------------------


def _plain_overlap(claims, sentences):
    return [max((len(c & s) for s in sentences), default=0) for c in claims]


def test_best_overlap_misses_nothing_and_compares_little():
    import random
    from collections import Counter

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: {vocabulary[min(2999, int(rng.paretovariate(0.6)))] for _ in range(n)}  # noqa: E731  a few words are in most sentences
    sentences = [draw(rng.randint(1, 25)) for _ in range(6000)]
    claims = [set(rng.choice(sentences)) for _ in range(60)] + [draw(12) for _ in range(60)] + [set(), {"nowhere"}]
    overlap = verify.BestOverlap(claims, Counter(w for s in sentences[:500] for w in s))
    for k, s in enumerate(sentences):
        overlap.meet(s)
        if k % 500 == 499:
            overlap.prune()
    assert overlap.best == _plain_overlap(claims, sentences)
    meeting = sum(1 for c in claims for s in sentences if c & s)
    assert overlap.compared < 0.1 * meeting


def test_support_in_any_equals_plain_overlaps_both_ways(spark, monkeypatch):
    import random

    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "the", "of", "law", "visa", "stay", "über", "ABC"]
    texts = [". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))).capitalize() for _ in range(rng.randint(1, 5))) for _ in range(200)] + ["", None]
    claims = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(40)] + [(40, None), (41, ""), (3, "alpha omega"), (None, "beta")]
    c, s = spark.createDataFrame(claims, "claim long, text string"), spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sets = [w for t in texts if t for w in verify.sentence_words(t)]
    want = []
    for k, t in claims:
        own = next(iter(verify.sentence_words(t or "")), set())
        r = max((len(own & x) for x in sets), default=0) / len(own) if own else 1.0
        want.append((str(k), round(r, 6), r < 0.6))
    for rows in (200_000, 1):
        monkeypatch.setattr(verify, "BROADCAST_ROWS", rows)
        assert sorted((str(r.claim), round(r.ratio, 6), r.flagged) for r in verify.support_in_any(c, s).collect()) == sorted(want)
    assert verify.support_in_any(c, s.limit(0)).where("ratio > 0 and ratio < 1").count() == 0


def test_short_quotes_need_no_pairs(spark, monkeypatch):
    import random

    rng = random.Random(11)
    texts = ["".join(rng.choice("ab é漢.") for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, ""]
    quotes = [(i, "".join(rng.choice("ab é漢.") for _ in range(rng.randint(1, 5)))) for i in range(60)] + [(60, ""), (61, None), (62, "zz"), (None, "a"), (3, "b")]
    q, s = df(spark, quotes, "quote_id long, quote string"), df(spark, list(enumerate(texts)) + [(None, "ab"), (5, "zz b")], "source_id long, text string").repartition(3)
    want = {(i, k) for i, x in quotes if x is not None for k, t in [*enumerate(texts), (None, "ab"), (5, "zz b")] if t is not None and x in t}
    for block in (50_000, 9):
        monkeypatch.setattr(verify, "SHORT_BLOCK", block)
        got = verify.containing(q, s)
        assert {tuple(r) for r in got.collect()} == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert verify.containing(q.limit(0), s).count() == 0 and verify.containing(q, s.limit(0)).count() == 0


def test_blocks_of_claims_and_sentences_equal_plain_overlaps(spark, monkeypatch):
    import random

    import numpy as np

    from corpusmill.operators import overlap

    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "ghijk" for c in "lmnop"]
    draw = lambda n: list(dict.fromkeys(words[min(149, int(rng.paretovariate(0.5)))] for _ in range(n)))
    sentences, claims = [draw(rng.randint(1, 40)) for _ in range(3000)], [draw(rng.randint(1, 60)) for _ in range(200)] + [["nowhere"]]
    monkeypatch.setattr(overlap, "LONGEST", 16)
    best = np.zeros(len(claims), np.int64)
    _, c_sizes, c_codes, c_words = next(overlap._blocked(enumerate(claims), 10**9))
    for at in range(0, 3000, 700):  # what one block gave bounds the next
        _, sizes, codes, vocabulary = next(overlap._blocked(enumerate(sentences[at : at + 700]), 10**9))
        overlap.SentenceSide(np.array(sizes), np.array(codes), vocabulary).meet(np.array(c_sizes), np.array(c_codes), c_words, best)
    want = [max(len(set(c) & set(s)) for s in sentences) for c in claims]
    assert best.tolist() == want

    # more claims than every task holds: blocks on both sides, broadcast or not, and no shuffle of pairs
    monkeypatch.setattr(verify, "FEW_CLAIMS", 5)
    monkeypatch.setattr(overlap, "SENTENCE_WORDS", 5_000)
    monkeypatch.setattr(overlap, "CLAIM_WORDS", 700)
    c, s = df(spark, [(k, " ".join(x)) for k, x in enumerate(claims)], "claim long, text string"), df(spark, [(". ".join(" ".join(x).capitalize() for x in sentences[k : k + 9]),) for k in range(0, 3000, 9)], "text string")
    for size in (64 << 20, 1):
        monkeypatch.setattr(overlap, "BLOCK_BYTES", size)
        got = {r.claim: r.ratio for r in verify.support_in_any(c, s).collect()}
        assert got == {k: n / len(x) for k, (n, x) in enumerate(zip(want, claims))}


def test_meeting_blocks_compares_little_whatever_it_takes_at_once(monkeypatch):
    import random

    import numpy as np

    from corpusmill.operators import overlap

    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    draw = lambda n: list(dict.fromkeys(words[min(3999, int(rng.paretovariate(0.35)))] for _ in range(n)))
    sentences, claims = [draw(rng.randint(2, 30)) for _ in range(4000)], [draw(rng.randint(1, 90)) for _ in range(80)] + [["nowhere"]]
    want = [max(len(set(c) & set(s)) for s in sentences) for c in claims]
    (_, sizes, codes, vocabulary), (_, c_sizes, c_codes, c_words) = next(overlap._blocked(enumerate(sentences), 10**9)), next(overlap._blocked(enumerate(claims), 10**9))
    side, c = overlap.SentenceSide(np.array(sizes), np.array(codes), vocabulary), (np.array(c_sizes), np.array(c_codes), c_words)
    moved, within = [], overlap._within

    def counted(starts, n):
        moved.append(int(n.sum()))
        return within(starts, n)

    monkeypatch.setattr(overlap, "_within", counted)
    side.meet(*c, np.array(want))  # bounds that nothing exceeds
    assert sum(moved) < 150_000  # 380,901 when one word of the reach led to a comparison
    for together, entries in ((4, 1 << 18), (4, 50), (1, 300), (9, 1)):
        monkeypatch.setattr(overlap, "TOGETHER", together)
        monkeypatch.setattr(overlap, "ENTRIES", entries)
        for start in (np.zeros(81, np.int64), np.maximum(np.array(want) - 2, 0), np.array(want) // 2):
            side.meet(*c, start)
            assert start.tolist() == want
        best = np.zeros(81, np.int64)
        side.count(*c, best)
        assert best.tolist() == want


def test_blocks_of_equal_codes_and_other_words_are_two_blocks(spark, monkeypatch):
    from corpusmill.operators import overlap

    monkeypatch.setattr(verify, "FEW_CLAIMS", 1)
    monkeypatch.setattr(overlap, "SENTENCE_WORDS", 3)
    monkeypatch.setattr(overlap, "LONGEST", 1)
    monkeypatch.setattr(overlap, "spread", lambda rows: rows.coalesce(1))
    names = "alpha beta gamma delta omega sigma kappa lambda theta".split()
    texts = [" ".join(names[k : k + 3]).capitalize() for k in (0, 3, 6)]
    c, s = df(spark, list(enumerate(texts)), "claim long, text string"), df(spark, [(". ".join(texts),)] * 40, "text string")
    assert {r.claim: r.ratio for r in verify.support_in_any(c, s).collect()} == {0: 1.0, 1: 1.0, 2: 1.0}


def test_few_quotes_pass_once_over_texts_and_many_meet_them_by_keys(spark, monkeypatch):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "“Delta”", "eps&amp;", "zeta;", "Eta.", "theta "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    rows = [(i % 2, None if i == 7 else i % 40, t) for i, t in enumerate(texts)]  # sources repeat
    points = []
    for p in range(40):
        t = (rng.choice(texts) or "nothing of the kind stands here") if p % 4 else "a quote that stands nowhere at all"
        at = rng.randint(0, len(t) // 2)
        points.append((rng.randint(0, 2), p, rng.randint(0, 40), t[at : at + rng.randint(20, 80)], "x"))
    src = df(spark, rows, "id long, source int, text string")
    pts = df(spark, points, "id long, point int, cited int, quote string, applies string")
    columns = ["id", "point", "part", "cited", "source", "applies", "moved", "kept"]
    with monkeypatch.context() as m:
        m.setattr(verify, "_standing_keyed", lambda *_: pytest.fail("few quotes need no keys"))
        few = sorted(map(str, verify.check_quotes(pts, src).select(columns).collect()))
    monkeypatch.setattr(verify, "SHORT_BLOCK", 3)
    many = sorted(map(str, verify.check_quotes(pts, src).select(columns).collect()))
    assert few == many and sum("kept=True" in x for x in few) >= 5
