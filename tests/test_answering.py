"""Fetching, refresh and the steps that a client answers, with clients of files and functions."""

import io
import json
import sys
import zipfile
from urllib.parse import quote

import pytest
from pyspark import cloudpickle

from corpusmill.engine import Engine
from corpusmill.operators import answering
from corpusmill.sources import fetch, landing


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def put(root, url, body, status=None):
    f = root / quote(url, safe="")
    f.write_bytes(body)
    if status:
        (root / f"{f.name}.status").write_text(str(status))


def test_fetch_with_fallback_and_landing(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("usc/t8.xml", "<a/>")
        f.writestr("readme.txt", "no")
    put(a, "http://x/page?q=1", b"<p>hi</p>")
    put(a, "http://x/doc", b"%PDF-1.7 body")
    put(a, "http://x/shut", b"", 403)
    put(b, "http://x/shut", b"<p>by the other way</p>")
    put(a, "http://x/usc.zip", z.getvalue())
    put(a, "http://x/broken", b"", 500)

    def refusing(url):
        if url == "http://x/down":
            raise ConnectionError("no route")
        return fetch.folder(str(a))(url)

    rows = [("s1", "html", "http://x/page?q=1"), ("s1", "html", "http://x/doc"), ("s1", "html", "http://x/shut"), ("s2", "zip", "http://x/usc.zip"), ("s3", "html", "http://x/broken"), ("s3", "html", "http://x/down"), ("s3", "html", None)]
    requests = spark.createDataFrame(rows, "source string, declared string, url string")
    got = fetch.fetched(requests, fetch.with_fallback(refusing, fetch.folder(str(b))))
    manifest, rejects = fetch.land(got, str(tmp_path / "raw"), "2026-01-02 00:00:00")
    assert {(r.source, r.name) for r in manifest.collect()} == {("s1", "page.html"), ("s1", "doc.pdf"), ("s1", "shut.html"), ("s2", "t8.xml")}
    assert {(r.url, r.problem) for r in rejects.collect()} == {("http://x/broken", "status 500"), ("http://x/down", "status 404"), (None, "no url")}
    again = fetch.fetched(requests.where("source = 's1' and url like '%doc'"), fetch.folder(str(a)))
    manifest, _ = fetch.land(again, str(tmp_path / "raw"), "2026-01-03 00:00:00")
    assert {(r.source, r.name) for r in manifest.collect()} == {("s1", "doc.pdf"), ("s2", "t8.xml")}


def test_conditional_refresh(spark, tmp_path):
    m, table = tmp_path / "m", str(tmp_path / "table")
    m.mkdir()
    put(m, "u:a", b"new a")
    put(m, "u:b", b"older")
    put(m, "u:c", b"", 503)
    items = spark.createDataFrame([("a", "u:a"), ("b", "u:b"), ("c", "u:c"), ("d", "")], "name string, url string")
    shipped = spark.createDataFrame([("b", b"old b")], "name string, content binary")
    seen = lambda name, new, old: "less recent" if new == b"older" else ""
    run = lambda now, **k: {r.name: (r.status, r.detail) for r in fetch.refresh(spark, items, table, fetch.folder(str(m)), seen, now, shipped, **k).collect()}
    content = lambda: {r.source: bytes(r.content) for r in fetch.raw(spark, table).collect()}
    assert run("2026-01-01 00:00:00") == {"a": ("updated", ""), "b": ("kept", "rejected: less recent"), "c": ("kept", "status 503"), "d": ("skipped", "")}
    assert content() == {"a": b"new a"}
    put(m, "u:a", b"newer a")
    assert run("2026-01-01 05:00:00")["a"] == ("unchanged", "")  # checked lately
    assert content() == {"a": b"new a"}
    assert run("2026-01-02 05:00:00")["a"] == ("updated", "") and content() == {"a": b"newer a"}
    assert run("2026-01-04 05:00:00")["a"] == ("unchanged", "")  # equal bytes
    assert run("2026-01-04 06:00:00", force=True)["a"] == ("unchanged", "")


def model(prompts):
    """A model that answers by what the prompt asks for."""
    out = []
    for p in prompts:
        if "search queries" in p:
            out.append("1. employment authorization rules\n- x\n* filing windows for students")
        elif '"points"' in p:
            out.append(json.dumps({"answer": " You must file. ", "points": [{"source": 1, "quote": "Every student must file the form before the end.", "applies": "a"}, {"source": 1, "quote": "This was never written anywhere at all.", "applies": "b"}], "ask": ""}))
        elif '"attributions"' in p:
            out.append(json.dumps({"attributions": [{"claim": 0, "source": 1}, {"claim": 1, "source": 99}]}))
        elif '"verdict"' in p:
            out.append('{"verdict": "supported"}' if "blue" in p.split("Claim:")[0] else "no json")
        elif "unemployment_days" in p:
            out.append('{"cpt_full_time_months": 14, "unemployment_days": [24, 40]}')
        else:
            out.append(None)
    return out


def failing(prompts):
    raise ConnectionError("away")


def test_planned_issues(spark):
    long = "I left my job and my card has expired while the office has not decided on it yet"
    q = spark.createDataFrame([(1, long, "none"), (2, "short one", "")], "id long, question string, facts string")
    assert [(r.id, r.issue) for r in answering.planned_issues(q, model).orderBy("n").collect()] == [(1, "employment authorization rules"), (1, "filing windows for students")]
    assert answering.planned_issues(q, failing).count() == 0


def test_cited_answers_keep_only_the_sources_words(spark):
    p = spark.createDataFrame([(1, "q")], "id long, prompt string")
    s = spark.createDataFrame([(1, 1, "Intro. Every student must file the form before the end. More.")], "id long, source int, text string")
    answers, quotes = answering.cited_answers(p, s, model)
    assert answers.first().answer == "You must file." and [r.quote for r in quotes.collect()] == ["Every student must file the form before the end"]
    answers, quotes = answering.cited_answers(p, s, lambda ps: ["Plain prose." for _ in ps])
    assert answers.first().answer == "Plain prose." and quotes.count() == 0
    answers, _ = answering.cited_answers(p, s, failing)
    assert answers.first().answer == ""


def test_attributed_claims(spark):
    a = spark.createDataFrame([(1, "p", "You must file.\n\nYou may not work.\n\nSee [1], you must.\n\nFine.", 3), (2, "p", "Nothing.", 3)], "id long, prompt string, text string, n_sources int")
    assert [(r.id, r.claim, r.text, r.source) for r in answering.attributed_claims(a, model).orderBy("claim").collect()] == [(1, 0, "You must file.", 1), (1, 1, "You may not work.", None)]
    assert [r.source for r in answering.attributed_claims(a, failing).collect()] == [None, None]


def test_facts_must_have_been_said(spark):
    q = spark.createDataFrame([(1, "I did 14 months of full-time CPT"), (2, "I did some CPT and was unemployed for twenty-four, then 40 days"), (3, "hello")], "id long, question string")
    got = {r.id: (r.cpt_full_time_months, r.unemployment_days) for r in answering.extracted_facts(q, model).collect()}
    assert got == {1: (14.0, None), 2: (None, [24.0, 40.0]), 3: (None, None)}


def test_judged_claims(spark):
    c = spark.createDataFrame([(1, "The sky is blue.", ""), (2, "It is green.", None), (3, "x", "")], "id long, claim string, facts string")
    p = spark.createDataFrame([(1, 0, "A", "blue sky"), (2, 0, "B", "other"), (1, 1, "C", "more")], "id long, ord int, citation string, text string")
    assert {r.id: r.flagged for r in answering.judged_claims(c, p, model).collect()} == {1: False, 2: True, 3: True}
    assert all(r.flagged for r in answering.judged_claims(c, p, failing).collect())


def test_engine_init_add_remember_and_answer(spark, tmp_path):
    from corpusmill.sources import registry

    defs, landed, shipped = tmp_path / "defs", tmp_path / "landed", tmp_path / "shipped"
    for d in (defs, landed / "guide", shipped / "notes", shipped / "guide"):
        d.mkdir(parents=True)
    (defs / "guide.toml").write_text('title = "Guide"\ntier = 3\n')
    (defs / "notes.toml").write_text('title = "Notes"\ntier = 4\n')
    (defs / "none.toml").write_text('title = "None"\n')
    (landed / "guide" / "g.txt").write_text("Every student must file the form before the end.\n\nA student may work on campus for twenty hours.")
    (shipped / "guide" / "old.txt").write_text("An old guide that must not be built.")
    (shipped / "notes" / "n.txt").write_text("Shipped notes about passports and visas.")
    engine = Engine(spark, str(tmp_path / "corpus"))
    reports = engine.init(registry.load(spark, str(defs)), landing.by_source(spark, str(landed)), landing.by_source(spark, str(shipped)))
    assert {r["slug"]: r["chunks"] > 0 for r in reports} == {"guide": True, "notes": True, "none": False}
    assert engine.passages().where("text like '%old guide%'").count() == 0
    got = engine.add(spark.createDataFrame([("/x/mine.md", "My own letter about the form."), ("/x/a.exe", "no")], "path string, text string"))
    assert got["chunks"] == 1 and got["refused"] == ["/x/a.exe"]
    assert engine.remember("Remember that I filed in March.", "2026-01-01")["chunks"] == 2
    assert engine.passages(private=False).where("shard = 'me'").count() == 0 and engine.passages().where("shard = 'me' and tier = 9").count() == 2
    a = engine.answer("Every student must file the form before the end.", model, k=3)
    assert a["status"] == "ok" and a["answer"] == "You must file." and [q["quote"] for q in a["quotes"]] in ([], ["Every student must file the form before the end"])
    assert [x["source"] for x in a["attributed"]] == [1]


def test_answers_quote_only_what_was_shown(spark, tmp_path):
    """A withheld passage's words, and those of a passage that the slate lacks, are no quotes; a finding's are."""
    engine = Engine(spark, str(tmp_path / "corpus"))
    shown = "Every student must report a change of address within ten days of the move."
    hidden, outside = "A student may stay for sixty days after the program has come to its end.", "A scholar may bring a spouse and minor children who are to be housed with them."
    finding = "Each student may be unemployed for ninety days in all and for no day more."
    rows = [(1, "p:1", "8 CFR § 1.1", 3, 0.9, True, shown), (2, "p:2", "8 CFR § 1.1", 3, 0.8, False, "")]
    slate = spark.createDataFrame([(0, *r, r[6]) for r in rows], "q long, rank int, id string, citation string, tier int, cosine double, usable boolean, served string, text string")
    engine.search_many = lambda queries, k=None, only=None, exclude=None: slate
    quotes = [shown, hidden, outside, finding]
    reply = json.dumps({"answer": "See [1].", "points": [{"source": 1, "quote": x, "applies": ""} for x in quotes], "ask": ""})
    chat = lambda prompts: ["" if "issues" in p else reply for p in prompts]
    got = engine.answer("What must a student report?", chat, results=[{"kind": "outcome", "decision": "D", "question": None, "quotes": [finding]}])
    assert [(q["source"], q["quote"]) for q in got["quotes"]] == [(1, shown.rstrip(".")), (3, finding.rstrip("."))]
    assert got["sources"][1]["usable"] is False and hidden not in got["prompt"]


def test_refresh_refuses_bad_registers_and_charts(spark, tmp_path, capsys):
    from corpusmill.__main__ import main
    from corpusmill.sources.registers import accepts, read_register

    good = """[[entry]]\nprovisions = ["8 CFR 214.2(f)"]\namended = ["(5) Some paragraph."]\nstatus = "stayed"\ncase = "A v. B"\ndocket = "1"\ncourt = "C"\norder_date = 2026-01-01\nscope = "all"\nrule = "R"\nchecked = 2026-02-01\n"""
    chart = 'month = "2026-05"\n[final_action_dates.EB-2]\nall = "C"\nindia = "2013-01-01"\n'
    old = good.encode()
    assert accepts("register.toml", old, None) == "" and accepts("bulletin.toml", chart.encode(), None) == ""
    for bad, why in ((good.replace("8 CFR 214.2(f)", "somewhere"), "unreadable provisions"), ("", "no entries"), (good.replace('["8 CFR 214.2(f)"]', "[]"), "no provisions"), (good.replace("2026-02-01", "2025-02-01"), "checked less recently"), ("[[entry", "TOML")):
        assert why in accepts("register.toml", bad.encode(), old), why
    for bad, why in ((chart.replace("2026-05", "May"), "no month"), (chart.replace('"C"', '"soon"'), "unreadable cell"), (chart.replace("2026-05", "2026-04"), "older"), ('month = "2026-05"\n', "no chart")):
        assert why in accepts("bulletin.toml", bad.encode(), chart.encode()), why
    m, table, root = tmp_path / "m", str(tmp_path / "t"), ["--root", str(tmp_path / "c")]
    m.mkdir()
    put(m, "u:r", old)
    assert main([*root, "refresh", "register.toml=u:r", str(m), table]) == 0
    put(m, "u:r", good.replace("8 CFR 214.2(f)", "somewhere").encode())
    assert main([*root, "refresh", "register.toml=u:r", str(m), table, "--force"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [r["status"] for r in out] == ["updated", "kept"] and "unreadable provisions" in out[1]["detail"]
    r = read_register(spark, good).first()
    assert (r.entry, r.case_name, r.docket, r.provisions, r.amended, str(r.checked)) == (1, "A v. B", "1", ["8 CFR 214.2(f)"], ["(5) Some paragraph."], "2026-02-01")


def test_command_line(spark, tmp_path, capsys):
    from corpusmill.__main__ import main

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("A private letter about forms.")
    m = tmp_path / "m"
    m.mkdir()
    put(m, "u:a", b"body")
    root = ["--root", str(tmp_path / "c")]
    assert main([*root, "add", str(tmp_path / "f" / "a.txt")]) == 0 and main([*root, "remember", "a note of mine"]) == 0
    assert main([*root, "refresh", "a=u:a", str(m), str(tmp_path / "t")]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x.get("chunks") for x in out[:2]] == [1, 2] and out[2]["status"] == "updated"


if __name__ == "__main__":
    pytest.main([__file__])
