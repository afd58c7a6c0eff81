"""HTML extraction, WARC archives and URL filters."""

import base64
import collections
import hashlib
import io
import random
import zipfile

import pytest

from corpusmill.llm import html_extraction, url_filters, warc_zip

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>Welcome to our site, it is nice.</p></header>
<div id="cookie-notice">We use cookies on this site. Please accept them now.</div><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div><aside>Side words here. And there is more text here in this sidebar for you.</aside><div class="content"><h1>Head &amp; line</h1><p>First  para is
long enough to be an article.<p>Ok.<ul><li>one</li><li>two <a href=x>link</a></li></ul><div class="ad">Buy this great thing now. It is cheap.</div><p>More text.</div>
<section id="comments"><h2>Comments</h2><article><p>I think this is a very good article. Thank you!</p></article></section></div>
<form><label>Name</label><input><button>Go</button></form><script>var t="</p>";</script><footer>Bye &copy; now</footer></body></html>"""
SCHEMA = "page_id long, url string, html string, sha1 string, payload string, text string"


def test_extraction():
    assert html_extraction.main_text(PAGE) == "Head & line\nFirst para is long enough to be an article.\nOk.\none\ntwo link\nMore text."
    for x in (None, "", "<", "<p", "<!--", "<script>x", "<p title=\"abc>x", "</p></div>", "&", "<a><b></a>"):
        assert isinstance(html_extraction.main_text(x), str)
    assert html_extraction.main_text("plain text only here with several words in it.") == "plain text only here with several words in it."
    body = "<article><p>A sentence that is long enough to stay here.</p></article>"
    assert html_extraction.main_text("<title>Never closed" + body) == "A sentence that is long enough to stay here."
    assert html_extraction.main_text(body + "<script>rest") == "A sentence that is long enough to stay here."
    assert isinstance(html_extraction.main_text('<a title="' * 20_000), str)
    long = "<article>" + "<p>A line of words that is a sentence.</p>" * 5000 + "</article>"
    assert html_extraction.main_text(long).count("\n") == 4999


def test_extraction_of_marked_regions():
    inner = "<h1>Title</h1><p>A first sentence that is long enough to stay here.</p>"
    more = "<p>And a last sentence that is long enough to stay as well.</p>"
    want = "Title\nA first sentence that is long enough to stay here.\nAnd a last sentence that is long enough to stay as well."
    for odd in (
        '<form><p>Give us your address now, please do so today.</p></form>', '<p>An <span class="ad">x <span>y</span> offer ends</span></p>'.replace("An ", ""), '<div hidden><p>Never seen by anyone who reads this page.</p></div>',
        '<p style="display: none">Never seen by anyone who reads this page.</p>', '<div role="alert"><p>Our offices are closed today. Please come back.</p></div>', '<ul class="share-buttons"><li><a href=x>Tweet</a></ul>',
    ):
        assert html_extraction.main_text(f"<body><article>{inner}{odd}{more}</article></body>") == want, odd
    for wrap in ('<div class="content-with-sidebar">%s</div>', '<p title="hidden class ad"></p><main>%s</main>', '<form><article>%s</article></form>', "<article><header>%s</header></article>", "<div>%s</div>", "<ul><li><a href=x>Menu</ul><div>%s</div>"):
        assert html_extraction.main_text("<body>" + wrap % (inner + more) + "</body>") == want, wrap


def test_extraction_rows(spark):
    rows = [(1, "u", PAGE, "a", "b", "c"), (None, None, None, "", "", ""), (2, None, "", "", "", ""), (2, None, "", "", "", "")]
    got = html_extraction.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_extraction.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def cut_value(cost, links, keep):
    value = sum(c for c, k in zip(cost, keep) if c > 0 and not k) - sum(c for c, k in zip(cost, keep) if c < 0 and k)
    return value + sum(w for u, v, w in links if keep[u] != keep[v])


def test_min_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        cost = [rng.randint(-30, 30) for _ in range(n)]
        links = [(i - 1, i, rng.randint(0, 20)) for i in range(1, n)] + [(rng.randrange(n), rng.randrange(n), rng.randint(0, 9)) for _ in range(n)]
        links = [(u, v, w) for u, v, w in links if u != v]
        best = min(cut_value(cost, links, [m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cut_value(cost, links, html_extraction.min_cut(cost, links)) == best


# --- WARC -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/x?y=1", "<p>one</p>", "s", "p", "t"), (2, "http://b/", "<p>one</p>", "s", "p", "t"), (3, None, None, "s", "p", "t"), (4, "http://c/ü\r\nX: 1", "", "s", "p", "t"),
        (5, "http://d/%41 b", "é\r\n\r\nWARC/1.1\r\n" * 10, "s", "p", "t"), (None, "http://n/", "<p>one</p>", "s", "p", "t"), (None, "http://n/", "alone", "s", "p", "t"),
        (6, "http://e/", "x" * 3_000_000, "s", "p", "t"), (7, "http://f/", "dup", "s", "p", "t"), (7, "http://g/", "dup", "s", "p", "t"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def expected(rows, least=0):
    best = {}
    for r in rows:
        h = r.html or ""
        if r.page_id is not None:
            best[h] = max(best.get(h, r.page_id), r.page_id)
    out = collections.Counter()
    for r in rows:
        b = (r.html or "").encode()
        first = best.get(r.html or "")
        revisit = len(b) >= least and r.page_id != first
        out[r.page_id, r.url, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, None if revisit else b] += 1
    return out


@pytest.mark.parametrize(("size", "least"), [(32_000_000, 0), (300, 0), (32_000_000, 5)])
def test_warc_round_trip(pages, tmp_path, size, least):
    written = warc_zip.write_archives(pages, str(tmp_path / "w"), size, least)
    back = warc_zip.read_archives(written).collect()
    got = collections.Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back)
    assert got == expected(pages.collect(), least)
    for r in written.collect():
        with zipfile.ZipFile(r.archive) as z:  # any other reader can open them
            assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())


def test_warc_empty(spark, tmp_path):
    written = warc_zip.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert written.count() == 0 and warc_zip.read_archives(written).count() == 0


def test_central_directory_zip64_and_comments():
    for force in (False, True):
        raw = io.BytesIO(b"")
        with zipfile.ZipFile(raw, "w", allowZip64=True) as z:
            with z.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=force) as f:
                f.write(b"abc" * 100)
            z.writestr("indexes/index.cdxj", "x" * 500, zipfile.ZIP_DEFLATED)
            z.comment = b"a comment PK"
        data = raw.getvalue()
        found = warc_zip.members(io.BytesIO(data), len(data))
        method, packed, full, offset = found["archive/data.warc.gz"]
        at = warc_zip.first_byte(io.BytesIO(data), offset)
        assert (method, packed, full) == (0, 300, 300) and data[at : at + 300] == b"abc" * 100
        assert found["indexes/index.cdxj"][0] == 8
    with pytest.raises(ValueError):
        warc_zip.members(io.BytesIO(b"no archive"), 10)


def test_zip64_directory():
    """A directory whose counts and offsets are only in the ZIP64 records."""
    import struct

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"12345")
    data = raw.getvalue()
    end = data.rfind(b"PK\x05\x06")
    start = struct.unpack_from("<I", data, end + 16)[0]
    length = struct.unpack_from("<I", data, end + 12)[0]
    entry = bytearray(data[start : start + length])
    offset = struct.unpack_from("<I", entry, 42)[0]
    struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
    extra = struct.pack("<HHQ", 1, 8, offset)
    struct.pack_into("<H", entry, 30, len(extra))
    entry += extra
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(entry), 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = data[:start] + bytes(entry) + record + locator + tail
    assert warc_zip.members(io.BytesIO(whole), len(whole))["a"] == (0, 5, 5, offset)


# --- URL filters ------------------------------------------------------------------------


def test_url_filters(spark):
    import datetime as dt

    d = dt.date
    entries = spark.createDataFrame(
        [
            ("l", "bad.com", "add", "2024-02-01", "block"), ("l", "bad.com", "remove", "2024-03-01", "block"), ("l", "bad.com", "add", "2024-06-01", "block"),
            ("m", "bad.com/Ok", "add", "2024-01-01", "allow"), ("z", "bad.com", "add", "2024-02-01", "allow"), ("z", "bad.com", "remove", "2024-02-02", "allow"),
            ("n", None, "add", "2024-01-01", "block"), ("n", "x.com", "add", None, "block"), ("n", "gone.com", "remove", "2024-01-01", "block"), ("n", "day.com", "add", "2024-01-01", "block"), ("n", "day.com", "remove", "2024-01-01", "block"),
        ],
        "list string, key string, action string, day string, verdict string",
    ).selectExpr("list", "key", "action", "try_to_date(day) as day", "verdict")
    cases = [
        ("http://www.bad.com/p", d(2024, 1, 31), False), ("http://www.bad.com/p", d(2024, 2, 1), False), ("http://www.bad.com/p", d(2024, 2, 2), True), ("http://www.bad.com/p", d(2024, 3, 1), False),
        ("HTTPS://u:p@BAD.com:80/ok/x", d(2024, 7, 1), False), ("http://bad.com/okay", d(2024, 7, 1), True), ("http://notbad.com/", d(2024, 7, 1), False), ("http://x.com/", d(2024, 7, 1), False),
        ("http://gone.com/", d(2024, 7, 1), False), ("http://day.com/", d(2024, 7, 1), False), (None, d(2024, 7, 1), False), ("no url", d(2024, 7, 1), False), ("http://bad.com", None, False), ("http://bad.com", d(2024, 7, 1), True), ("http://bad.com", d(2024, 7, 1), True),
    ]
    captures = spark.createDataFrame([(i, u, t, "clash", "x") for i, (u, t, _) in enumerate(cases)], "page_id long, url string, day date, list string, host string")
    got = {r.page_id: r for r in url_filters.decide(captures, entries).collect()}
    assert [got[i].blocked for i in range(len(cases))] == [b for *_, b in cases]
    assert got[4].list == "m" and got[4].n_active == 2 and got[2].valid_from == d(2024, 2, 1)
    assert url_filters.decide(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filters.decide(captures, entries.limit(0)).collect())


def test_url_filters_by_a_large_list(spark, monkeypatch):
    """A list of over 200,000 intervals joins as a shuffle, with the result of plain loops."""
    import datetime as dt

    from pyspark.sql import functions as F

    n = 110_000
    dated = spark.range(n).select(F.concat(F.lit("list"), (F.col("id") % 3).cast("string")).alias("list"), F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.org")).alias("key"), (F.col("id") % 50).alias("d"))
    on = dated.select("list", "key", F.lit("add").alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int")).alias("day"), F.lit("block").alias("verdict"))
    off = on.withColumn("action", F.lit("remove")).withColumn("day", F.date_add("day", 10))
    again = on.withColumn("day", F.date_add("day", 40))
    entries = on.unionByName(off).unionByName(again)
    assert url_filters.intervals(entries).count() == 2 * n > 200_000
    rng = random.Random(4)
    rows = [(i if i % 7 else None, f"http://www.h{k}.Example.org/p?q=1", dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(110))) for i, k in enumerate(rng.choices([5, 17, 99_999, n + 3], k=400))]
    rows += rows[:50]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date")
    found = url_filters.decide(captures, entries)
    assert "BroadcastHashJoin [key" not in found._jdf.queryExecution().executedPlan().toString()

    def blocked(url, day):
        k = int(url.split("h")[2].split(".")[0])
        since = (day - dt.date(2024, 1, 1)).days - k % 50
        return k < n and (0 <= since < 10 or since >= 40)

    want = collections.Counter((i, u, d, blocked(u, d)) for i, u, d in rows)
    assert collections.Counter((r.page_id, r.url, r.day, r.blocked) for r in found.collect()) == want


def test_url_filters_of_addresses_and_cases(spark):
    import datetime as dt

    entries = url_filters.entry_table(spark, (("l", "3.4", "add", "2024-01-01", "block"), ("l", "1.2.3.4/Bad", "add", "2024-01-01", "block"), ("l", "[::1]", "add", "2024-01-01", "block"), ("l", "it's.com", "add", "2024-01-01", "block")))
    day = dt.date(2024, 5, 5)
    urls = ["http://1.2.3.4/", "http://1.2.3.4/Bad/x", "http://1.2.3.4/bad", "http://[::1]:80/a", "http://a.3.4/", "http://it's.com/"]
    captures = spark.createDataFrame([(None, u, day) for u in urls], "page_id long, url string, day date")
    for fold, want in ((True, [False, True, True, True, True, True]), (False, [False, True, False, True, True, True])):
        got = {r.url: r.blocked for r in url_filters.decide(captures, entries, fold).collect()}
        assert [got[u] for u in urls] == want
    none = url_filters.entry_table(spark, ())
    assert not any(r.blocked for r in url_filters.decide(captures, none).collect())


def test_store_schemes(monkeypatch):
    from pyarrow import fs

    seen = []
    class Fake:
        @staticmethod
        def from_uri(uri):
            seen.append(uri)
            return None, uri

    monkeypatch.setattr(fs, "FileSystem", Fake)
    for uri in ("s3a://b/k", "s3n://b/k", "gs://b/k", "hdfs://n:1/k", "/tmp/x", "file:/tmp/x", "file:///tmp/x"):
        warc_zip._store(uri)
    assert seen == ["s3://b/k", "s3://b/k", "gs://b/k", "hdfs://n:1/k", "file:///tmp/x", "file:///tmp/x", "file:///tmp/x"]


def test_archives_of_clashing_columns_and_long_pages(spark, tmp_path):
    rows = [(1, "u", "x" * 9_000_000, 1, "s"), (2, "u", "x" * 9_000_000, 2, "s"), (2, None, "y", 3, "s"), (None, "v", "y", 4, "s"), (3, "w", None, 5, "s"), (None, None, "", 6, "s"), (None, "a", "only", 7, "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_bytes long, sha1 string")
    archives = warc_zip.write_archives(pages, str(tmp_path / "w"), archive_bytes=2000)
    got = sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_bytes)) for r in warc_zip.read_archives(archives).collect())
    want = [(1, "revisit", 2, 9_000_000), (2, "response", None, 9_000_000), (2, "response", None, 1), (None, "revisit", 2, 1), (3, "response", None, 0), (None, "revisit", 3, 0), (None, "response", None, 4)]
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("q", "\"'")
def test_quoted_values_have_no_length_bound(q):
    other = "'" if q == '"' else '"'
    value = f"<nav class={other}menu{other}>Not page text.</nav></article>" * 400  # some 20,000 characters
    page = f"<article data-props={q}{value}{q}><p>The text of the page.</p></article><p>{q} > after"
    assert [(b["text"], b["hard"], b["good"]) for b in html_extraction.blocks(page)] == [("The text of the page.", 0, 1), (f"{q} > after", 0, 0)]


@pytest.mark.parametrize("unit", ['<a ">" ', '<a "', "<p '>\"", "<a '>'\""])
def test_unclosed_quotes_cost_linear_time(unit, monkeypatch):
    looks, real = 0, html_extraction._BARE

    class Counted:
        def match(self, *a):
            nonlocal looks
            looks += 1
            return real.match(*a)

    monkeypatch.setattr(html_extraction, "_BARE", Counted())
    html_extraction.blocks(unit * 2000)
    assert looks < 20_000


SENTENCES = "<p>The first sentence of this page is here. The second one is here too. A third follows it. Then comes a fourth. The fifth ends it.</p>"


@pytest.mark.parametrize(
    "wrap",
    [
        '<article class="post comments-open">%s</article>', '<div class="layout sidebar-right"><article>%s</article></div>', '<div id="page" class="right-sidebar"><main>%s</main></div>',
        '<main class="search-results">%s</main>', '<div class="has-navbar navbar-fixed"><article>%s</article></div>', '<div class="form">%s</div>', '<body class="sidebar ads">%s</body>', '<form id="aspnet"><header><div>%s</div></header></form>',
    ],
)
def test_names_of_wrappers_lose_no_article(wrap):
    text = SENTENCES[3:-4]
    assert html_extraction.main_text("<html>" + wrap % SENTENCES) == text
    beside = '<div class="sidebar"><p>Some words that stand beside it all.</p></div><div class="comments"><article class="comment"><p>A reader wrote this long and friendly comment here.</p></article></div>'
    assert html_extraction.main_text(wrap % SENTENCES + beside) == text


def test_scripts_without_spaces():
    a, b = "这是一个很长的中文段落，它没有空格，但是它是一篇文章的内容，所以应该保留下来。", "これは本文の段落です。空白はありませんが、長い文章なので残るべきものです。"
    assert html_extraction.main_text(f"<div><p>{a}</p><p>{b}</p></div><ul><li><a href=x>主页</a><li><a href=y>新闻</a></ul>") == f"{a}\n{b}"


def test_slashes_close_no_scripts():
    page = f'<article>{SENTENCES}<script src="a.js"/>code</script><iframe src=https://x.com/>frame</iframe><svg/><p>And the last line.</p></article>'
    assert html_extraction.main_text(page) == SENTENCES[3:-4] + "\nAnd the last line."


def test_text_that_is_not_displayed():
    assert html_extraction.main_text(f'<div hidden>{SENTENCES}</div><div style="display : none">{SENTENCES}</div><article>{SENTENCES}<p>Then <span aria-hidden="true">not this</span> the end.</p></article>').count("first") == 1


def least_cuts(cost, links):
    """All labellings of least value, by trying every one."""
    best, found = None, []
    for m in range(1 << len(cost)):
        keep = [bool(m >> i & 1) for i in range(len(cost))]
        v = cut_value(cost, links, keep)
        if best is None or v < best:
            best, found = v, []
        if v == best:
            found.append(keep)
    return found


def test_labels_are_of_least_cost_on_small_pages():
    """Every labelling of random small pages is tried; the text is that of a cheapest one."""
    rng = random.Random(5)
    bits = ["<p>One two three four five six seven eight nine ten eleven.</p>", "<p>Word</p>", "<ul><li><a href=x>Link</a><li>plain item</ul>", "<h2>A heading</h2>", "<div class=ad>Buy it now, it is cheap.</div>", "<nav><a href=y>Home</a></nav>", "<article>", "</article>", "<div class=sidebar>", "</div>", "<p>Half a <a href=z>linked line</a></p>"]
    flips = 0
    for _ in range(150):
        page = "".join(rng.choices(bits, k=rng.randint(1, 9)))
        bs = html_extraction.blocks(page)
        cost, links = html_extraction.problem(bs) if bs else ([], [])
        if not bs or len(cost) > 13:
            continue
        keep = html_extraction.labels(bs)
        assert keep in [k[: len(bs)] for k in least_cuts(cost, links)]
        assert html_extraction.main_text(page) == "\n".join(b["text"] for b, k in zip(bs, keep) if k)
        flips += sum((c > 0) != k for c, k in zip(cost, keep))
    assert flips > 20


def test_the_cut_changes_labels_of_real_pages(spark):
    """On the driver's pages the cut, not a block's own cost, decides hundreds of blocks, and every article comes back whole."""
    import re

    flips = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        bs = html_extraction.blocks(r.html or "")
        keep = html_extraction.labels(bs) if bs else []
        flips += sum((html_extraction.costs(b) > 0) != k for b, k in zip(bs, keep))
        article = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        if article:
            import html

            plain = html.unescape(re.sub(r"<[^>]+>", " ", article[1])).split()
            assert html_extraction.main_text(r.html).split() == plain
    assert flips > 30


def test_very_long_and_odd_pages(spark):
    rows = [(1, "u", "<article>" + SENTENCES * 20_000 + "</article>", "a", "b", "c"), (1, "u", "x" * 3_000_000, "a", "b", "c"), (3, None, "<div>" * 50_000 + "deep", "a", "b", "c")]
    got = html_extraction.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and got[0].text.count("\n") == 19_999


ARTICLE = " ".join(f"This is plain sentence number {w} of the whole article text." for w in ("one", "two", "three", "four", "five"))


@pytest.mark.parametrize("beside", ["", "<nav><a href=x>Home</a> <a href=y>About us</a></nav>", "<footer>Copyright 2020 by the Foo Company. All rights reserved.</footer>", "<div class='cookie-banner'>We use cookies. Accept all of them now.</div>"])
@pytest.mark.parametrize(
    "page",
    [
        "<div class='social-science'>{}</div>", "<div class='related-work'>{}</div>", "<div class='ad-free content'>{}</div>", "<div id='content'><div class='alert-news'>{}</div></div>", "<div class='share-post-page'><article>{}</article></div>",
        "<div class='promo'><article>{}</article></div>", "<main id='notice'>{}</main>", "<article class='ad'>{}</article>", "<aside class='layout'><article>{}</article></aside>", "<div class='comments-page'><div>{}</div></div>",
    ],
)
def test_no_article_is_lost_to_a_wrapper_s_name(page, beside):
    text = html_extraction.main_text(beside + page.format(f"<p>{ARTICLE}</p>"))
    assert text == ARTICLE


def test_small_marked_elements_and_long_comments_stay_out():
    long_comments = "".join(f"<div class='comment'><p>{ARTICLE}</p></div>" for _ in range(6))
    small = "<div class='related'><p>Read this other fine story today. It is good.</p></div><div class='ad'><p>Buy two of them now. They are cheap.</p></div>"
    assert html_extraction.main_text(f"<article><p>{ARTICLE}</p></article>{small}<section class='comments'>{long_comments}</section>") == ARTICLE
    assert html_extraction.main_text(f"<div><p>{ARTICLE}</p></div><aside><p>{ARTICLE}</p><p>{ARTICLE}</p></aside>") == ARTICLE


def test_formulas_are_text_and_their_source_is_not():
    page = f"<p>{ARTICLE} Let <math><semantics><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><annotation encoding='application/x-tex'>x+1</annotation></semantics></math> be real.</p>"
    assert html_extraction.main_text(page) == f"{ARTICLE} Let x+1 be real."
