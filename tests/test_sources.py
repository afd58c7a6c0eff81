"""Sources, chunkers, shards, streaming and the engine's entry points."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.engine import Engine
from corpusmill.functions import text as T
from corpusmill.operators import embed, ingest
from corpusmill.sources import landing, registry, shards, tables
from corpusmill.streaming import ingest as stream

FILL = "These are words that make the section long enough to count as a passage of the manual in every respect. " * 3
MANUAL = f"""<html><h1>Volume 6 - Immigrants</h1><h1>Part F - Employment</h1><h1>Chapter 5 - Degrees</h1><p>Intro {FILL}[12]</p>
<h2></h2><h2>D. Waiver</h2><p>{FILL}</p><h3>3. Prongs</h3><p>{FILL}</p><h3>4. Tiny</h3><p>too short</p>
<h1>Chapter 6 - Short</h1><p>few words</p><h1>Part G - Next</h1><h1>Chapter 1 - One</h1><p>{FILL}</p><h1>Other</h1><p>{FILL}</p></html>"""

REGULATION = """<DIV1 N="8"><DIV5 N="214"><DIV8 N="214.2"><HEAD>§ 214.2 Special requirements.</HEAD>
<TABLE><TR><TD>(a) Foreign officials</TD></TR><TR><TD>(b) Visitors</TD></TR><TR><TD>(c) Transits</TD></TR></TABLE>
<P>(a) Foreign officials. Text a.</P><P>(i) roman one</P><P>(c) Transits too early.</P><P>(b) Visitors. Text b.</P><FP-1>flush</FP-1><P>(c) Transits. Text c.</P></DIV8>
<DIV8 N="204.5"><HEAD>§ 204.5 Petitions.</HEAD><P>(a) General.</P><P>(b) x</P><P>(c) x</P><P>(d) x</P><P>(e) x</P><P>(f) x</P><P>(g) x</P><P>(h) at least three of the following:</P><P>(i) first item</P><P>(ii) second</P></DIV8></DIV5></DIV1>"""


def test_manual(spark):
    pages = spark.createDataFrame([(1, MANUAL)], "page_id long, html string")
    got = {r.citation: r for r in ingest.manual_units(pages).collect()}
    assert set(got) == {"USCIS PM Vol 6, Pt F, Ch 5", "USCIS PM Vol 6, Pt F, Ch 5, D", "USCIS PM Vol 6, Pt F, Ch 5, D.3", "USCIS PM Vol 6, Pt G, Ch 1"}
    assert got["USCIS PM Vol 6, Pt F, Ch 5, D.3"].label == "3. Prongs" and "[12]" not in " ".join(got["USCIS PM Vol 6, Pt F, Ch 5"].paragraphs)
    assert got["USCIS PM Vol 6, Pt F, Ch 5, D"].heads == "Chapter 5 - Degrees > D. Waiver"


def test_regulation(spark):
    files = spark.createDataFrame([("t.xml", REGULATION.encode())], "path string, content binary")
    got = {r.citation: r for r in ingest.regulation_units(files).collect()}
    assert got["8 CFR § 214.2(a)"].paragraphs == ["(a) Foreign officials. Text a.", "(i) roman one", "(c) Transits too early."]
    assert got["8 CFR § 214.2(b)"].paragraphs == ["(b) Visitors. Text b.", "flush"] and got["8 CFR § 214.2(c)"].label == "Special requirements — Transits"
    assert got["8 CFR § 204.5(h)"].paragraphs == ["(h) at least three of the following:", "(i) first item", "(ii) second"] and "8 CFR § 204.5(i)" not in got
    p = ingest.passages(ingest.regulation_units(files), "reg", 2)
    assert p.columns == [*ingest.COLUMNS, "embed_text"] and [r.id for r in p.orderBy("id").collect()][0] == "reg:0"


def test_statute_text_and_pdf(spark):
    body = "Any person shall do as this section says, and each word here counts. " * 4
    xml = f"<section><num>§ 1324a.</num><heading>Unlawful employment</heading><p>{body}</p></section><section><num>§ 2</num><heading>x</heading>short</section>"
    got = ingest.statute_units(spark.createDataFrame([("u.xml", xml)], "path string, text string")).collect()
    assert [(r.citation, r.label) for r in got] == [("8 U.S.C. § 1324a", "Unlawful employment")]
    t = spark.createDataFrame([("/x/notes.md", "One para.\n\nTwo para."), ("/x/p.html", "<p>A line.</p>")], "path string, text string")
    assert {r.citation: r.paragraphs for r in ingest.text_units(t).collect()} == {"notes.md": ["One para.", "Two para."], "p.html": ["A line."]}
    units, rejects = ingest.pdf_units(spark.createDataFrame([("a.pdf", b"%PDF-broken")], "path string, content binary"))
    assert units.count() == 0 and rejects.count() == 1


def test_landing(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.xml", "<a/>")
        z.writestr("b.txt", "no")
    files = spark.createDataFrame([("z.zip", raw.getvalue())], "path string, content binary")
    assert [bytes(r.content) for r in landing.zip_members(files).collect()] == [b"<a/>"]
    s = spark.createDataFrame([("ecfr", b"%PDF-1"), ("ecfr", b"<x"), ("web", b"<x")], "d string, c binary").select(landing.sniffed(F.col("d"), F.col("c")).alias("x"))
    assert [r.x for r in s.collect()] == [".pdf", ".xml", ".html"]
    c = spark.createDataFrame([(json.dumps({"titles": [{"number": 8, "up_to_date_as_of": "2026-01-02"}, {"number": 9, "up_to_date_as_of": "x"}]}),)], "json string")
    assert landing.edition(c, 8).first().edition == "2026-01-02"
    rows = [("a", "", 50.0, "", False), ("b", "u", 3.0, "", False), ("c", "u", 50.0, "older", False), ("d", "u", 50.0, "", True), ("e", "u", None, "", False)]
    got = landing.refresh_status(spark.createDataFrame(rows, "name string, url string, age_hours double, problem string, same boolean")).collect()
    assert [r.status for r in got] == ["skipped", "unchanged", "kept", "unchanged", "updated"]


def test_registry_and_profile(spark, tmp_path):
    (tmp_path / "b.toml").write_text('title = "B"\ntier = 1\nurls = ["x"]\n')
    (tmp_path / "a.toml").write_text('slug = "zz"\ntier = 2\n')
    assert [(r.slug, r.tier) for r in registry.load(spark, str(tmp_path)).collect()] == [("b", 1), ("zz", 2)]
    assert registry.lookup(registry.load(spark, str(tmp_path)), "b").first().title == "B"
    (tmp_path / "c.toml").write_text("nope = 1\n")
    with pytest.raises(ValueError):
        registry.load(spark, str(tmp_path))
    p = str(tmp_path / "profile")
    assert registry.load_profile(p) == {}
    registry.set_value(p, "status", 'F-1 "x"')
    registry.set_value(p, "stem", "true")
    assert registry.load_profile(p) == {"status": 'F-1 "x"', "stem": True}
    assert registry.known({"a": "", "b": 0, "c": False, "d": None, "e": "x"}) == {"e": "x"}


CHART = """<h3>Final Action Dates for employment-based cases</h3><table><tr><th>Employment-based</th><th>All Chargeability Areas</th><th>CHINA-mainland</th><th>Notes</th></tr>
<tr><td>1st</td><td>C</td><td>01JUN23</td><td>n</td></tr><tr><td>Other Workers</td><td>U</td><td>15MAY</td><td></td></tr><tr><td>F2A</td><td>C</td><td>C</td><td></td></tr></table>
<p>Dates for Filing of employment-based</p><table><tr><td>Employment</td><td>India</td></tr><tr><td>EB-2 adv</td><td>June&nbsp;1, 2023</td></tr></table>"""


def test_tables_and_cube(spark):
    cells = tables.cells(spark.createDataFrame([(1, CHART), (2, None), (3, "no table")], "page_id long, html string"))
    got = {(r.chart, r.category, r.area): r.cell for r in tables.chart_cells(cells).collect()}
    assert got == {
        ("final_action", "EB-1", "all"): "C", ("final_action", "EB-1", "china"): "2023-06-01", ("final_action", "EB-3 other workers", "all"): "U", ("final_action", "EB-3 other workers", "china"): None,
        ("dates_for_filing", "EB-2", "india"): "2023-06-01",
    }
    rows = tables.chart_cells(cells).where("cell is not null").collect()
    toml = tables.to_toml(rows, "2026-07", "consensus of two", ["b", "a"])
    cube = tables.read_cube(spark, toml)
    assert {(r.chart, r.category, r.area): r.cell for r in cube.collect()} == {k: v for k, v in got.items() if v}
    assert tables.cube_problems(cube).count() == 0 and tables.cube_problems(cube, "2026-08").count() == 1
    assert tables.cube_problems(cube.withColumn("cell", F.lit("soon"))).count() == 4 and tables.cube_problems(cube.limit(0)).count() == 1
    page = spark.createDataFrame([("<title>Visa Bulletin For July 2026</title>",)], "h string")
    assert page.select(tables.bulletin_month(T.visible(F.col("h"))).alias("m")).first().m == "2026-07"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.n_words(F.lit("  "))) == 0 and one(T.n_tokens(F.lit("a b c"))) == 3
    assert one(T.strip_html(F.lit("a<script>x</script><style>y</style><b>b</b> &amp;"))) == "a b &amp;"
    assert one(T.visible(F.lit("<td>A&nbsp;&amp; B</td>"))) == "A & B"
    assert one(T.unescape(F.lit("&#39;&#x20AC;&#128512; &lt;b&gt; &amp;lt; &#0; &#xD800; &#x110000; &nope;"))) == "'€😀 <b> &lt; &#0; &#xD800; &#x110000; &nope;"
    assert one(T.opens_with(F.lit("Students in colleges."), F.lit("Students in colleges, universities"))) and not one(T.opens_with(F.lit("x"), F.lit("")))
    assert one(T.issue_lines(F.lit("1. First issue here\n- Second issue line\nshort\n" + "x" * 200))) == ["First issue here", "Second issue line"]
    assert one(T.usable_words(F.lit("head\n[SUSPENDED — withheld: A, 1] two words"))) == 2
    assert one(T.echoes(F.lit("The Quote  itself"), F.lit("the quote itself")))
    assert one(T.month_template(F.lit("/{year}/{month}.html"), F.lit("2026-07-01").cast("date"))) == "/2026/july.html"
    assert one(T.situational(F.lit("Some time ago the agency made a rule that all people there followed"))) and not one(T.situational(F.lit("Some time ago the agency made a rule that all people there followed"), True))
    assert one(T.label(F.lit("D. Waiver"))) == "D" and one(T.promises_list(F.lit("the following: ")))


def test_shards_round_trip(spark, tmp_path):
    root = str(tmp_path / "corpus")
    rows = [(f"a:{i}", "t", "c", "t", "p", "u", "a", 3, "k", "s") for i in range(3)]
    schema = "id string, text string, citation string, title string, path string, url string, shard string, tier int, kind string, source_title string"
    df = spark.createDataFrame(rows, schema)
    shards.write(df.withColumn("embed_text", F.lit("x")), root)
    shards.write(df.limit(2).withColumn("shard", F.lit("b")), root)
    shards.write(df.limit(1), root)  # replaces a, leaves b
    got = shards.read(spark, root)
    assert {r.shard: r["count"] for r in got.groupBy("shard").count().collect()} == {"a": 1, "b": 2} and "embed_text" not in got.columns
    both, rejects = shards.read_all(spark, [root, str(tmp_path / "missing")])
    assert both.count() == 3 and len(rejects) == 1


def test_vectors(spark):
    d = spark.createDataFrame([("1", "alpha beta", ""), ("2", "alpha beta", "gamma"), ("3", "", "")], "id string, text string, embed_text string")
    got = {r.id: r.embedding for r in embed.vectors(d, embed.hashing(16)).collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in got.values()) and got["1"] != got["2"]


def test_engine_and_cli(spark, tmp_path, capsys):
    e = Engine(spark, str(tmp_path / "corpus"))
    html = spark.createDataFrame([(1, MANUAL)], "page_id long, html string")
    assert e.build(html, "manual", "manual")["chunks"] > 0
    assert e.build(html.select("page_id"), "broken", "manual")["problem"]
    hits = e.search("waiver prongs of the manual", k=3).collect()
    assert hits and sum(h.usable for h in hits) <= 3 and {h.citation for h in hits} <= {r.citation for r in e.passages().collect()}
    assert e.ask("q", results=[{"kind": "needs", "question": "How many?", "decision": None}]) == {"status": "needs", "questions": ["How many?"]}
    out = e.ask("what is the waiver?", issues=["prongs of the waiver"], results=[{"kind": "outcome", "decision": "D", "question": None}], k=4)
    assert out["findings"] == ["D"] and out["sources"] and out["sources"][0]["rank"] == 1 and out["prompt"].startswith("[1] ")
    from corpusmill.__main__ import main

    assert main(["profile", str(tmp_path / "p"), "status=F-1"]) == 0 and json.loads(capsys.readouterr().out) == {"status": "F-1"}


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "beta")], "doc_id long, text string")
    docs.write.parquet(src)
    q = stream.write_postings(stream.landed(spark, src, "doc_id long, text string"), out, str(tmp_path / "cp"))
    q.awaitTermination()
    assert {(r.id, r.term, r.tf) for r in spark.read.parquet(out).collect()} == {(1, "alpha", 2), (1, "beta", 1), (3, "beta", 1)}
    q = stream.write_postings(stream.landed(spark, src, "doc_id long, text string"), out, str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 3  # nothing is read twice
    sf = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(sf)
    events = spark.readStream.schema(spark.read.parquet(sf).schema).parquet(sf)
    w = stream.event_windows(events).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.sql("select sum(n) as n from w").first().n == spark.read.parquet(sf).count()


def test_landing_helpers(spark):
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert {(r.k, r.v) for r in landing.first_available(a, b, "k").collect()} == {("x", 1), ("y", 3)}
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "1"})], "o map<string,string>, n map<string,string>")
    assert [r[0] for r in m.select(landing.merged_manifest(F.col("o"), F.col("n"))).collect()] == [{"a": "1", "b": "3"}, {"c": "1"}]
    nd = '{"message": {"content": "Hel"}}\nbad\n{"message": {"content": "lo"}, "done": true}\n{"message": {"content": "!"}}'
    sse = 'data: {"choices": [{"delta": {"content": "A"}}]}\n\ndata: {"choices": [{"delta": {"content": "B"}, "finish_reason": "stop"}]}\ndata: [DONE]\ndata: {"choices": [{"delta": {"content": "C"}}]}'
    assert [r[0] for r in spark.createDataFrame([(nd,), (sse,), ("",)], "raw string").select(landing.reply_text(F.col("raw"))).collect()] == ["Hello", "AB", ""]


def test_publishers(spark):
    two = CHART + CHART.replace("01JUN23", "01JUN24")
    pages = spark.createDataFrame([("p", f"<p>July 2026</p>{two}"), ("q", CHART), ("r", "July 2026 without tables")], "source string, html string")
    got = tables.publisher_cells(pages, "July 2026").collect()
    assert {r.source for r in got} == {"p"} and {r.cell for r in got if r.area == "china"} == {"2023-06-01"}
    text = "For Employment-Based Preference Filings: For all employment-based preference categories, you must use the Dates for Filing chart in the Department of State Visa Bulletin for July 2026."
    page = spark.createDataFrame([(f"<p>{text}</p>",)], "h string")
    assert page.select(tables.agency_chart(F.col("h"), "July 2026").alias("x")).first().x == "dates_for_filing"
    assert page.select(tables.agency_chart(F.col("h"), "June 2026").alias("x")).first().x is None


def test_eval_files(spark, tmp_path):
    from corpusmill.operators import evalkit

    (tmp_path / "h1.json").write_text(json.dumps({"question": "q", "sources": [["c1", "t1"], ["c2", "t2"]], "tail": ""}))
    assert {(r.slug, r.source, r.citation) for r in evalkit.read_slates(spark, str(tmp_path / "h1.json")).collect()} == {("h1", 1, "c1"), ("h1", 2, "c2")}
    (tmp_path / "labels").write_text('{"h1": "S U", "h2": "N"}')
    assert {r.slug: r.letters for r in evalkit.read_labels(spark, str(tmp_path / "labels")).collect()} == {"h1": "S U", "h2": "N"}
    evalkit.save_answers(spark.createDataFrame([(1, "a")], "id long, text string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_numbering_and_first_seen(spark):
    import random

    from corpusmill.plans.numbering import numbered

    rows = [(i, random.Random(i).choice("aab")) for i in range(500)] + [(1000, None), (1001, None)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(7)
    got = {r.k: r.n for r in numbered(df, ["k"], ["g"]).collect()}
    for g in ("a", "b", None):
        assert [got[k] for k, v in rows if v == g] == list(range(sum(v == g for _, v in rows)))
    assert [r.n for r in numbered(df, ["k"]).orderBy("k").collect()] == list(range(502))
    assert numbered(df.limit(0), ["k"]).count() == 0
    first = ingest.first_seen(df, [F.col("g")], "k").collect()
    assert {r.g: r.k for r in first} == {g: min(k for k, v in rows if v == g) for g in ("a", "b", None)}


def test_shared_folder(spark, monkeypatch):
    from corpusmill.plans import staging

    assert staging.shared_dir(spark).startswith("file:") or "/" in staging.shared_dir(spark)
    assert staging._temporary() == staging._temporary()
    small = spark.range(10)
    assert staging.small_or_shuffled(small, 5) is small and staging.small_or_shuffled(small, 10) is not small
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    staging.small_batches(spark)
    assert spark.conf.get(key).startswith(str(8 << 20))
    spark.conf.set(key, "16m")
    staging.small_batches(spark)
    assert spark.conf.get(key) in ("16m", "16777216", "16777216b")
    spark.conf.unset(key)


def test_splittable_join(spark):
    from corpusmill.plans.staging import cut, splittable

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    unique = cut(spark.createDataFrame([(1, 10), (3, 30)], "k long, n long").groupBy("k").agg(F.max("n").alias("n")))
    assert {(r.k, r.v, r.n) for r in splittable(rows, unique, ["k"], "left").collect()} == {(1, "a", 10), (1, "b", 10), (2, "c", None), (None, "d", None)}
    assert splittable(rows, unique, ["k"]).count() == 2
