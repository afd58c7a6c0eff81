"""Dates, validity, consensus and rules."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import dates as D
from corpusmill.operators import consensus, rules, validity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


D0 = lambda s: F.lit(s).cast("date")


@pytest.mark.parametrize(("cell", "want"), [("C", "C"), ("current", "C"), ("U", "U"), ("01JUN23", "2023-06-01"), ("June 1, 2023", "2023-06-01"), ("Jun. 1, 2023", "2023-06-01"), ("15MAY", None), ("01JUN23*", "2023-06-01"), ("30FEB24", None), ("", None)])
def test_cells(spark, cell, want):
    assert one(spark, D.parse_cell(F.lit(cell))) == want


@pytest.mark.parametrize(("pd", "cut", "want"), [("2020-01-01", "2020-01-02", "CURRENT"), ("2020-01-02", "2020-01-02", "NOT CURRENT"), ("2020-01-02", "C", "CURRENT"), ("2020-01-02", "U", "NOT CURRENT"), ("2020-01-02", None, "UNCONFIRMED")])
def test_compare(spark, pd, cut, want):
    assert one(spark, D.compare(D0(pd), F.lit(cut).cast("string"))) == want


@pytest.mark.parametrize(("month", "want"), [("2026-06-01", "current"), ("2026-07-01", "upcoming"), ("2026-05-01", "stale")])
def test_timing(spark, month, want):
    assert one(spark, D.timing(D0(month), D0("2026-06-20"))) == want


@pytest.mark.parametrize(("text", "want"), [("born 2021-03-15", dt.date(2021, 3, 15)), ("2021-02-30 or March 1 2021", None), ("March 15, 2021", dt.date(2021, 3, 15)), ("15 March 2021", dt.date(2021, 3, 15)), ("Mar. 5 2021", dt.date(2021, 3, 5)), ("soon", None)])
def test_date_of(spark, text, want):
    assert one(spark, D.date_of(F.lit(text))) == want


def test_windows_and_status(spark):
    end = D0("2027-05-14")
    w = one(spark, D.filing_windows(end))
    assert (w[0].opens, w[0].closes) == (dt.date(2027, 2, 13), dt.date(2027, 7, 13)) and w[1].opens == dt.date(2027, 5, 15)
    for today, want in (("2027-02-12", "opens in 1 days"), ("2027-02-13", "OPEN — 150 days remaining"), ("2027-07-13", "OPEN — 0 days remaining"), ("2027-07-14", "CLOSED 1 days ago")):
        assert one(spark, D.status(D0("2027-02-13"), D0("2027-07-13"), D0(today))) == want
    assert one(spark, D.status(D0("2027-02-13"), F.lit(None).cast("date"), D0("2028-01-01"))) == "open"
    none = F.lit(None).cast("date")
    names = [x.name for x in one(spark, D.windows(F.lit("F-1"), end, none, none, F.lit(None).cast("boolean"), F.lit(True), D0("2026-03-01")))]
    assert names == ["filing", "grace", "gap"]
    assert one(spark, D.windows(F.lit("H-1B"), none, none, none, F.lit(True), F.lit(True), D0("2026-03-01"))) == []


def test_staleness_is_strict(spark):
    for fetched, want in (("2026-06-01", False), ("2026-05-31", True), (None, True)):
        assert one(spark, D.stale(F.lit(fetched).cast("date"), F.lit(14), D0("2026-06-15"))) is want


@pytest.mark.parametrize(("country", "want"), [("Hong Kong, China", "all"), ("PRC", "china"), ("india ", "india"), ("Mexico", "mexico"), ("Filipino", "philippines"), ("Norway", "all"), ("  ", None)])
def test_areas(spark, country, want):
    assert one(spark, D.area_of(F.lit(country))) == want


# --- validity ------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("provision", "citation", "text", "want"),
    [
        ("8 CFR 214.2(f)(5)", "8 CFR § 214.2(f)", "(5) Duration", True), ("8 CFR 214.2(f)(5)", "8 CFR § 214.2(f)", "(5)  (i) x", True), ("8 CFR 214.2(f)(5)", "8 CFR § 214.2(f)", "see (5) above", False),
        ("8 CFR 214.2(f)(5)", "8 CFR § 214.2(f)", None, True), ("8 CFR § 214.2", "8 CFR § 214.20", "x", False), ("8 CFR § 214.2", "8 CFR § 214.2(f)(5)(iv)", "x", True),
        ("8 CFR § 274a.12", "8 CFR § 274a.12(c)", "x", True), ("8 CFR § 274.12", "8 CFR § 274a.12(c)", "x", False), ("8 U.S.C. § 1324a", "8 USC 1324a(b)", "x", True), ("9 CFR § 214.2", "8 CFR § 214.2", "x", False),
        ("8 CFR § 214.2(m)", "8 CFR § 214.2(f)", "(m) Students", False), ("nonsense", "8 CFR § 214.2", "x", False),
    ],
)
def test_covering(spark, provision, citation, text, want):
    p = spark.createDataFrame([(1, citation, text)], "id long, citation string, text string")
    v = spark.createDataFrame([(1, provision)], "entry int, provision string")
    assert (validity.covering(p, v).count() > 0) is want


PARA = "(5) Duration of status. The student may remain for the whole period that the school has set out in the record of the program, and for sixty days more."
OTHER = "(6) Course of study. " + "Words that stay in force go on here and are long enough to be used as a passage of their own. " * 3


REGISTER = "entry int, provisions array<string>, amended array<string>, case_name string, docket string"


def served_of(spark, texts, amended, citation="8 CFR § 214.2(f)"):
    """What is left of each text, with one entry a list of paragraphs."""
    passages = spark.createDataFrame([(i, citation, t) for i, t in enumerate(texts)], "id long, citation string, text string").repartition(3)
    register = spark.createDataFrame([(k, ["8 CFR § 214.2(f)(5)"], ps, "ABCD"[k], str(k + 1)) for k, ps in enumerate(amended)], REGISTER)
    return {r.id: r for r in validity.redacted(passages, register).collect()}


LONG_TAIL = " ".join(f"word{i}" for i in range(30))


def test_amended_paragraphs_are_cut(spark):
    mark, other = "[SUSPENDED — withheld: A, 1]", OTHER + LONG_TAIL
    cases = [
        (f"8 CFR § 214.2(f)\n{PARA} {other}", f"8 CFR § 214.2(f)\n{mark} {' '.join(other.split())}"),
        (f"head\n{other} {PARA[:130]}", f"head\n{' '.join(other.split())} {mark}"),
        (f"head\n{PARA[-130:]} {other}", f"head\n{mark} {' '.join(other.split())}"),
        (f"head\n{PARA.replace(' ', '  ')} {other}", f"head\n{mark} {' '.join(other.split())}"),
        (PARA.replace("status. The", "status.The") + other, mark + " ".join(other.split())),
        (f"head\n{PARA}{PARA} {other}", f"head\n{mark}{' '.join(PARA.split())} {' '.join(other.split())}"),
        ("head\nnothing here", "head\nnothing here"), ("", ""), (f"head\n{PARA}", ""),
    ]
    got = served_of(spark, [c[0] for c in cases], [[PARA]])
    assert [got[i].served for i in range(len(cases))] == [c[1] for c in cases]
    assert [got[i].suspended for i in range(len(cases))] == [False] * 8 + [True]
    assert [len(got[i].entries) for i in range(len(cases))] == [1] * 6 + [0, 0, 1]


def plain_cut(text, amended):
    """Entry numbers that stand in a text, and their intervals in it without white space, by plain searches."""
    body = "".join((text.split("\n", 1)[1] if "\n" in text else text).split())
    hit = {}
    for k, paragraphs in enumerate(amended):
        for p in map("".join, map(str.split, paragraphs)):
            at, end = body.find(p[:90]), body.find(p[-90:])
            if p and at >= 0:
                hit.setdefault(k, set()).update(range(at, min(len(body), at + len(p))))
            elif p and end >= 0:
                hit.setdefault(k, set()).update(range(max(0, end + len(p[-90:]) - len(p)), end + len(p[-90:])))
    return body, hit


def test_amended_paragraphs_of_any_length_are_found_wherever_they_stand(spark):
    rng = random.Random(9)
    filler = lambda n: "".join(rng.choice("abcdefgh éß\n漢") for _ in range(n))
    amended = [[filler(n) for n in (3, 17, 64)], [filler(89), filler(90), filler(91)], [filler(400), filler(2000)], ["aaaa" * 60, "  "]]
    texts = []
    for _ in range(60):
        p = rng.choice(amended[rng.randrange(4)])
        cut_at = rng.choice([len(p), len(p), 95])
        texts.append("head\n" + filler(rng.randrange(200)) + rng.choice([p, p[:cut_at], p[-cut_at:], " ".join(p)]) + filler(rng.randrange(3000)))
    texts += ["x\n" + "a" * 500, "漢" * 300, filler(5000), "h\n" + amended[2][0] + "  " + amended[1][1] + LONG_TAIL]
    got = served_of(spark, texts, amended)
    for i, t in enumerate(texts):
        body, hit = plain_cut(t, amended)
        assert got[i].entries == sorted(hit), i
        gone = set().union(*hit.values()) if hit else set()
        if hit and not got[i].suspended:
            left = re.sub(r"\[SUSPENDED — withheld: [A-D], \d\]", "", got[i].served.split("\n", 1)[1] if "\n" in t else got[i].served)
            assert "".join(left.split()) == "".join(ch for k, ch in enumerate(body) if k not in gone), i


def test_redaction_of_odd_rows(spark):
    passages = spark.createDataFrame([(1, "8 CFR § 214.2(f)", None), (1, "8 CFR § 214.2(f)", "other"), (None, "8 CFR § 214.2(f)", f"h\n{PARA}"), (2, None, PARA), (3, "no citation", PARA), (4, "8 CFR § 214.2(m)", PARA)], "id long, citation string, text string")
    register = spark.createDataFrame([(1, ["8 CFR § 214.2(f)(5)"], [PARA], "A", "1")], REGISTER)
    rows = sorted((str(r.id), str(r.text)[:5], r.suspended) for r in validity.redacted(passages, register).collect())
    assert rows == sorted([("1", "None", True), ("1", "other", False), ("None", f"h\n{PARA}"[:5], False), ("2", PARA[:5], False), ("3", PARA[:5], False), ("4", PARA[:5], False)])
    assert all(r.served == (r.text or "") for r in validity.redacted(passages.where("text is not null"), spark.createDataFrame([], REGISTER)).collect())
    assert validity.redacted(passages.limit(0), register).count() == 0


def test_many_paragraphs_meet_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(validity, "BROADCAST_ROWS", 1)
    test_amended_paragraphs_are_cut(spark)


def test_covering_joins_by_keys_only(spark):
    parts = ["", "(a)", "(a)(1)", "(a)(1)(i)", "(b)", "(a)(2)"]
    p = spark.createDataFrame([(i, f"8 CFR § 1.2{x}", t) for i, (x, t) in enumerate((x, t) for x in parts for t in ("(1) One (i) More", "(a)(1) (i)(A) x", "(2)  Two", None))], "id long, citation string, text string")
    v = spark.createDataFrame([(k, f"8 C.F.R. 1.2{x}") for k, x in enumerate([*parts, "(a)(1)(i)(A)"])], "entry int, provision string")
    got = {(r.id, r.entry) for r in validity.covering(p, v).collect()}
    path = lambda s: re.findall(r"\((\w+)\)", s.lower())
    want = set()
    for r in p.collect():
        for e in v.collect():
            a, b = path(e.provision), path(r.citation)
            n = min(len(a), len(b))
            if a[:n] == b[:n] and (len(a) <= len(b) or r.text is None or re.search(rf"\({a[len(b)]}\)\s*[A-Z(]", r.text)):
                want.add((r.id, e.entry))
    assert got == want
    plan = validity.covering(p, v)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "NestedLoop" not in plan


def test_redacted(spark):
    passages = spark.createDataFrame(
        [(1, "8 CFR § 214.2(f)", f"h\n{PARA} {OTHER}"), (2, "8 CFR § 214.2(f)", f"h\n{PARA}"), (3, "8 CFR § 214.2(m)", f"h\n{PARA}"), (4, "8 CFR § 248.1(f)", "h\nany text"), (5, "note", None)],
        "id long, citation string, text string",
    )
    register = spark.createDataFrame(
        [(1, ["8 CFR § 214.2(f)(5)"], [PARA], "A", "1", "2026-01-01", "Old rule", None), (2, ["8 CFR § 248.1(f)"], [], "B", "2", "2026-01-01", None, "rest")],
        "entry int, provisions array<string>, amended array<string>, case_name string, docket string, checked string, instead string, not_covered string",
    )
    got = {r.id: r for r in validity.redacted(passages, register).collect()}
    assert "SUSPENDED" in got[1].served and "Course of study" in got[1].served and not got[1].suspended and got[1].entries == [1]
    assert got[2].suspended and got[2].served == "" and got[3].entries == [] and "Duration" in got[3].served
    assert got[4].suspended and got[4].entries == [2] and got[5].served == ""
    assert {r.entry for r in validity.affecting(validity.redacted(passages, register), register).collect()} == {1, 2}
    notes = {r.entry: r.note for r in validity.note(register).collect()}
    assert "What governs instead: Old rule" in notes[1] and "Still in force: rest" in notes[2]
    assert validity.register_problems(register).count() == 0
    assert validity.register_problems(register, register.withColumn("checked", F.lit("2027-01-01"))).count() == 1
    assert validity.register_problems(register.limit(0)).count() == 1


def test_span_merge(spark):
    rng = random.Random(9)
    rows = [(k, a, a + rng.randint(0, 30)) for k in range(20) for a in (rng.randint(0, 200) for _ in range(15))]
    got = {}
    for r in validity.merged_spans(spark.createDataFrame(rows, "k long, a long, b long"), "k").collect():
        got.setdefault(r.k, []).append((r.a, r.b))
    for k in range(20):
        out = []
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        assert sorted(got[k]) == [tuple(x) for x in out]


def test_consensus_and_carry_forward(spark):
    rows = [("p", "f", "EB-1", "all", "C"), ("q", "f", "EB-1", "all", "C"), ("p", "f", "EB-2", "all", "C"), ("q", "f", "EB-2", "all", "U"), ("p", "f", "EB-3", "all", "C"), ("p", "f", "EB-3", "all", "C"), ("q", "f", "EB-3", "all", None)]
    c = consensus.consensus(spark.createDataFrame(rows, "source string, chart string, category string, area string, cell string"))
    got = {r.category: (r.cell, r.status) for r in c.collect()}
    assert got == {"EB-1": ("C", "agreed"), "EB-2": (None, "disputed"), "EB-3": (None, "single source")}
    before = spark.createDataFrame([("f", k, "all", "U") for k in ("EB-1", "EB-2", "EB-3", "EB-4")], "chart string, category string, area string, cell string")
    kept = {r.category: (r.cell, r.origin) for r in consensus.carry_forward(c, before).collect()}
    assert kept == {"EB-1": ("C", "today"), "EB-3": ("U", "carried"), "EB-4": ("U", "carried")}


# --- rules ---------------------------------------------------------------------------


def decide(spark, column):
    return one(spark, column)


def test_training_limit(spark):
    f = lambda m, n: decide(spark, rules.training_limit(F.lit(m), F.lit(n).cast("double")))
    assert f(True, 12).decision.startswith("INELIGIBLE") and f(True, 11).decision.startswith("NOT barred")
    assert f(True, None).fact == "cpt_full_time_months" and f(False, 14) is None and "14 months" in f(True, 14).because


def test_unemployment(spark):
    def f(days, stem, mentioned=True):
        d = F.lit(None).cast("array<double>") if days is None else F.array(*[F.lit(float(x)) for x in days])
        return decide(spark, rules.unemployment(F.lit(mentioned), d, F.lit(stem).cast("boolean")))

    assert f([30, 20], False).decision.startswith("40 days of unemployment REMAIN of the 90-day") and "30 + 20 = 50" in f([30, 20], False).because
    assert f([90], False).decision.startswith("0 days") and f([91], False).decision.startswith("OVER THE LIMIT: 91")
    assert f([100], True).decision.startswith("50 days") and f([10], None).fact == "stem_extension" and f(None, True).fact == "unemployment_days"
    assert f(None, True, False) is None


def test_pending_rules(spark):
    T, N = F.lit(True), F.lit(None).cast("boolean")
    assert decide(spark, rules.travel_pending(T, T, T, N)).kind == "outcome"
    assert decide(spark, rules.travel_pending(T, T, T, T)).fact == "cos_pending" and decide(spark, rules.travel_pending(T, T, N, N)).fact == "cos_pending"
    assert decide(spark, rules.travel_pending(T, N, T, N)) is None
    end = F.lit("2026-01-01").cast("date")
    assert "2026-06-30 (180 days after 2026-01-01)" in decide(spark, rules.work_pending(T, T, N, N, T, end)).decision
    assert decide(spark, rules.work_pending(T, T, N, N, N, end)).fact == "stem_timely" and decide(spark, rules.work_pending(T, T, N, T, T, end)).fact == "stem_decided"


def test_priority_rule(spark):
    s = lambda x: F.lit(x).cast("string")
    f = lambda c, a, d, fa, df: decide(spark, rules.priority_date(F.lit(True), s(c), s(a), F.lit(d).cast("date"), s(fa), s(df), s("2026-06")))
    r = f("EB-2", "india", "2014-01-01", "2014-02-01", None)
    assert "Final Action Dates: CURRENT (cut-off 2014-02-01)" in r.decision and "Dates for Filing: UNCONFIRMED" in r.decision
    assert f(None, None, None, "C", "C").fact == "eb_category" and f("EB-2", None, None, "C", "C").fact == "country_of_birth" and f("EB-2", "all", None, "C", "C").fact == "priority_date"


def test_stated_numbers(spark):
    assert sorted(one(spark, rules.said_numbers(F.lit("twenty-four days, 10.5 and Ten")))) == [10.0, 10.5, 24.0]
    m = lambda v, t: one(spark, rules.months_stated(F.lit(float(v)), F.lit(t)))
    assert m(12, "one year of full-time CPT") and not m(12, "a year of CPT") and m(14, "14 months full time") and not m(9, "full-time CPT")
    d = lambda vs, t: one(spark, rules.days_stated(F.array(*[F.lit(float(v)) for v in vs]), F.lit(t)))
    assert d([30, 20], "unemployed 30 then twenty days") and not d([50], "unemployed 30 then 20 days") and not d([30], "30 days")


def test_contradictions(spark):
    rows = [
        (1, "unemployment_limit", "40 days of unemployment REMAIN", "days used: 50; limit 90", "I had 50 days", "You used 50 days. You have 80 days left."),
        (2, "unemployment_limit", "40 days of unemployment REMAIN", "days used: 50; limit 90", "I had 50 days", "You have 40 days left. The grace period is 60 days."),
        (3, "cos_travel_abandonment", "ABANDONS", "", "", "Travel does not abandon it."),
        (4, "cpt_full_time_year", "INELIGIBLE for OPT", "", "", "You are eligible for OPT."),
        (5, "cpt_full_time_year", "INELIGIBLE for OPT", "", "", "You are not eligible for OPT."),
        (6, "stem_pending_work", "You MAY CONTINUE", "", "", "You must stop working now."),
    ]
    df = spark.createDataFrame(rows, "id long, rule string, decision string, because string, question string, text string")
    assert {r.id for r in rules.contradictions(df).collect()} == {1, 3, 4, 6}


def test_overlay_render_and_questions(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, rules.overlay(s("a"), s(None), s("c"), s(None))) == "c"
    results = rules.evaluate(rules.training_limit(F.lit(True), F.lit(14.0)), rules.unemployment(F.lit(True), F.array(F.lit(1.0)), F.lit(None).cast("boolean")))
    assert [r.rule for r in one(spark, results)] == ["cpt_full_time_year", "unemployment_limit"]
    assert "because: 14 months" in one(spark, rules.render(results)) and len(one(spark, rules.questions(results))) == 1
    assert re.match("Are you on", one(spark, rules.questions(results))[0])


def test_resolve_asks_and_keeps(spark):
    def decide(facts):
        return [{"kind": "needs", "fact": "stem_extension"}] if "stem_extension" not in facts else [{"kind": "outcome", "fact": None}]

    assert rules.resolve(decide, lambda r: {r["fact"]: True, "says_pending": True}, {}) == ([{"kind": "outcome", "fact": None}], {"stem_extension": True})
    assert rules.resolve(decide, lambda r: {}, {})[0][0]["kind"] == "needs"


def test_rendering(spark):
    t = D0("2027-03-01")
    text = one(spark, D.render(D.filing_windows(D0("2027-05-14")), t))
    assert text.startswith("COMPUTED DEADLINES (today = 2027-03-01):\n  filing: 2027-02-13 → 2027-07-13  [OPEN — 134 days remaining]")
    assert one(spark, D.render(F.array().cast("array<struct<name:string,opens:date,closes:date>>"), t)) == ""
    assert one(spark, validity.headline(F.lit("stayed"), F.lit("A"), F.lit("1"), D0("2026-01-02"), F.lit("all"))) == "STAYED: A, 1, 2026-01-02 (all)"
    reg = spark.createDataFrame([("2026-01-01", ["a", "b"]), ("2026-01-10", ["c"])], "checked string, provisions array<string>")
    r = validity.register_summary(reg, "2026-01-20").first()
    assert (r.max_age, r.any_stale, r.provisions) == (19, True, 3)
