"""Temporal, validity, consensus and rule queries over orders, lineitem, events and literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import dates as D
from corpusmill.functions import text as T
from corpusmill.operators import asof as A
from corpusmill.operators import consensus as C
from corpusmill.operators import rules as R
from corpusmill.operators import validity as V
from corpusmill.plans.registry import Registry
from corpusmill.plans.staging import table
from corpusmill.sources import registry

query = Registry()

TODAY = "1996-06-15"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, 'filing' AS name, (d - 90)::DATE AS opens, (d + 60)::DATE AS closes FROM o
UNION ALL SELECT o_orderkey, 'grace', (d + 1)::DATE, (d + 60)::DATE FROM o""")
def filing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", F.explode(D.filing_windows(F.col("d"))).alias("w")).select("o_orderkey", "w.*")


@query(f"""WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderdate::DATE AS d, DATE '{TODAY}' AS t FROM orders),
w AS (SELECT o_orderkey, 'filing' AS name, (d - 90)::DATE AS opens, (d + 60)::DATE AS closes, t FROM o WHERE s = 'F'
UNION ALL SELECT o_orderkey, 'grace', (d + 1)::DATE, (d + 60)::DATE, t FROM o WHERE s = 'F'
UNION ALL SELECT o_orderkey, 'extension', (d + 275)::DATE, (d + 365)::DATE, t FROM o
UNION ALL SELECT o_orderkey, 'grace after work', (d + 366)::DATE, (d + 425)::DATE, t FROM o
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'allowance 150' ELSE 'allowance 90' END, d, NULL, t FROM o
UNION ALL SELECT o_orderkey, 'gap', DATE '1996-04-01', DATE '1996-09-30', t FROM o WHERE s = 'F' AND o_orderkey % 3 = 0)
SELECT o_orderkey, name, opens, closes, CASE WHEN t < opens THEN 'opens in ' || (opens - t) || ' days' WHEN t > closes THEN 'CLOSED ' || (t - closes) || ' days ago' WHEN closes IS NOT NULL THEN 'OPEN — ' || (closes - t) || ' days remaining' ELSE 'open' END AS status FROM w""")
def window_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    d = F.to_date("o_orderdate")
    ws = D.windows(F.col("o_orderstatus"), d, d, F.date_add(d, 365), F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0, today)
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(ws).alias("w")).select("o_orderkey", "w.*")
    return x.select("*", D.status(F.col("opens"), F.col("closes"), today).alias("status"))


@query(f"SELECT o_orderkey, coalesce(DATE '{TODAY}' - o_orderdate::DATE, 9999)::BIGINT AS age_days, coalesce(DATE '{TODAY}' - o_orderdate::DATE, 9999) > 365 AS stale FROM orders")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lit(TODAY).cast("date")
    return _orders(spark, sf_dir).select("o_orderkey", D.age(F.col("d"), t).cast("long").alias("age_days"), D.stale(F.col("d"), F.lit(365), t).alias("stale"))


_CUTS = "CASE o_orderkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'U' WHEN 2 THEN '1995-03-15' END"


@query(f"SELECT o_orderkey, cut, CASE WHEN cut IS NULL THEN 'UNCONFIRMED' WHEN cut = 'C' THEN 'CURRENT' WHEN cut = 'U' THEN 'NOT CURRENT' WHEN d < TRY_CAST(cut AS DATE) THEN 'CURRENT' ELSE 'NOT CURRENT' END AS verdict FROM (SELECT o_orderkey, o_orderdate::DATE AS d, {_CUTS} AS cut FROM orders)")
def cutoff_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _orders(spark, sf_dir).withColumn("cut", F.expr(_CUTS))
    return x.select("o_orderkey", "cut", D.compare(F.col("d"), F.col("cut")).alias("verdict"))


@query(f"SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, CASE WHEN date_trunc('month', o_orderdate)::DATE = DATE '1996-06-01' THEN 'current' WHEN date_trunc('month', o_orderdate)::DATE > DATE '1996-06-01' THEN 'upcoming' ELSE 'stale' END AS timing FROM orders GROUP BY 1, 3")
def month_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _orders(spark, sf_dir).groupBy(F.trunc("d", "MM").alias("month")).agg(F.count("*").alias("n"))
    return m.select("month", "n", D.timing(F.col("month"), F.lit(TODAY).cast("date")).alias("timing"))


_CELL_SQL = """CASE o_orderkey % 9 WHEN 0 THEN 'C' WHEN 1 THEN 'Unavailable*' WHEN 2 THEN upper(strftime(d, '%d%b%y')) WHEN 3 THEN strftime(d, '%B %-d, %Y') WHEN 4 THEN strftime(d, '%b. %d %Y')
WHEN 5 THEN '31FEB' || strftime(d, '%y') WHEN 6 THEN '15MAY' WHEN 7 THEN upper(strftime(d, '%d%b%y')) || ' *' ELSE ' current' END"""
_READ_SQL = """CASE WHEN o_orderkey % 9 IN (0, 8) THEN 'C' WHEN o_orderkey % 9 = 1 THEN 'U' WHEN o_orderkey % 9 IN (2, 7) THEN '20' || strftime(d, '%y-%m-%d') WHEN o_orderkey % 9 IN (3, 4) THEN strftime(d, '%Y-%m-%d') END"""


@query(f"SELECT o_orderkey, {_CELL_SQL} AS raw, {_READ_SQL} AS cell FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def parse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as the cells of a chart, in every spelling and some that are no date."""
    k, f = F.col("o_orderkey") % 9, lambda p: F.date_format("d", p)
    short = F.upper(f("ddMMMyy"))
    raw = F.when(k == 0, "C").when(k == 1, "Unavailable*").when(k == 2, short).when(k == 3, f("MMMM d, yyyy")).when(k == 4, f("MMM. dd yyyy")).when(k == 5, F.concat(F.lit("31FEB"), f("yy"))).when(k == 6, "15MAY").when(k == 7, F.concat(short, F.lit(" *"))).otherwise(" current")
    x = _orders(spark, sf_dir).select("o_orderkey", raw.alias("raw"))
    return x.select("o_orderkey", "raw", D.parse_cell(F.col("raw")).alias("cell"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE + 4018 AS d FROM orders)
SELECT o_orderkey, d FROM o UNION ALL SELECT o_orderkey, (d + 40)::DATE FROM o WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, (d + 80)::DATE FROM o WHERE o_orderkey % 3 = 2""")
def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences about orders: ISO dates, prose dates in three forms, and days that do not exist."""
    f, k = lambda n, p: F.date_format(F.date_add("d", 4018 + n), p), F.col("o_orderkey") % 3
    more = F.when(k == 1, F.concat(F.lit("It is due "), f(40, "MMMM d, yyyy"), F.lit(" or never."))).when(k == 2, F.concat(F.lit("Due "), f(40, "MMM. dd yyyy"), F.lit(" and then on "), f(80, "MMMM d"), F.lit("th, "), f(80, "yyyy"), F.lit("."))).otherwise("On Feb. 30, 2026 nothing happens.")
    x = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("File by "), f(0, "yyyy-MM-dd"), F.lit(" or by 2027-02-31. "), more).alias("text"))
    return x.select("o_orderkey", F.explode(D.dates_in(F.col("text"))).alias("x")).select("o_orderkey", "x.d")


@query("SELECT o_orderkey, l_linenumber, l_shipdate::DATE AS ship, o_orderdate::DATE + 30 AS bound, abs(l_shipdate::DATE - (o_orderdate::DATE + 30))::BIGINT AS off FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE abs(l_shipdate::DATE - (o_orderdate::DATE + 30)) BETWEEN 1 AND 3")
def band_match_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates 1 to 3 days off a computed boundary: an equi-join with a band on top."""
    o = _orders(spark, sf_dir).select("o_orderkey", F.date_add("d", 30).alias("bound"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship"))
    off = F.abs(F.datediff("ship", "bound"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(off.between(1, D.DRIFT)).select("o_orderkey", "l_linenumber", "ship", "bound", off.cast("long").alias("off"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers read the quantity class of a part: publishers reading a cell."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("source"), F.col("l_returnflag").alias("chart"), F.col("l_linestatus").alias("category"), F.col("l_partkey").cast("string").alias("area"), F.when(F.col("l_quantity") > 48, "C").otherwise("U").alias("cell"))


@query("""WITH h AS (SELECT l_returnflag AS chart, 'q' AS category, (l_suppkey % 9)::VARCHAR AS area, date_trunc('month', l_shipdate::DATE)::DATE AS month, max(l_shipdate::DATE) AS cell
  FROM lineitem WHERE (month(l_shipdate::DATE) + l_suppkey % 9) % 3 = 0 GROUP BY ALL),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'N' ELSE 'R' END AS chart, 'q' AS category, (o_custkey % 10)::VARCHAR AS area, o_orderdate::DATE AS d, date_trunc('month', o_orderdate::DATE)::DATE AS m FROM orders)
SELECT o_orderkey, month, strftime(cell, '%Y-%m-%d') AS cell, CASE WHEN month IS NULL THEN 'none' WHEN month = m THEN 'current' ELSE 'stale' END AS timing,
CASE WHEN cell IS NULL THEN 'UNCONFIRMED' WHEN d + 20 < cell THEN 'CURRENT' ELSE 'NOT CURRENT' END AS status
FROM o ASOF LEFT JOIN h ON o.chart = h.chart AND o.category = h.category AND o.area = h.area AND o.m >= h.month""")
def cutoff_as_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority dates of orders against month-stamped charts of lineitem that keep their history; two months of three have none."""
    ship = F.to_date("l_shipdate")
    h = table(spark, sf_dir, "lineitem").where((F.month(ship) + F.col("l_suppkey") % 9) % 3 == 0)
    h = h.groupBy(F.col("l_returnflag").alias("chart"), F.lit("q").alias("category"), (F.col("l_suppkey") % 9).cast("string").alias("area"), F.trunc(ship, "month").cast("date").alias("month")).agg(F.max(ship).cast("string").alias("cell"))
    chart = F.when(F.col("o_orderkey") % 3 == 0, "A").when(F.col("o_orderkey") % 3 == 1, "N").otherwise("R")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), chart.alias("chart"), F.lit("q").alias("category"), (F.col("o_custkey") % 10).cast("string").alias("area"), F.to_date("o_orderdate").alias("on"), F.date_add(F.to_date("o_orderdate"), 20).alias("priority"))
    return A.cutoffs_as_of(o, h).withColumnRenamed("id", "o_orderkey")


_VOTES = """r AS (SELECT DISTINCT l_suppkey AS source, l_returnflag AS chart, l_linestatus AS category, l_partkey::VARCHAR AS area, CASE WHEN l_quantity > 48 THEN 'C' ELSE 'U' END AS cell FROM lineitem),
v AS (SELECT chart, category, area, count(DISTINCT cell) AS n_values, count(DISTINCT source) AS n_sources, min(cell) AS c FROM r GROUP BY ALL),
con AS (SELECT chart, category, area, CASE WHEN n_values = 1 AND n_sources >= 2 THEN c END AS cell, n_values, n_sources, CASE WHEN n_values > 1 THEN 'disputed' WHEN n_sources < 2 THEN 'single source' ELSE 'agreed' END AS status FROM v)"""


@query(f"WITH {_VOTES} SELECT * FROM con")
def consensus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consensus(_readings(spark, sf_dir))


@query(f"""WITH {_VOTES}, p AS (SELECT DISTINCT chart, category, area, 'U' AS cell FROM r WHERE area::INT % 2 = 0)
SELECT coalesce(con.chart, p.chart) AS chart, coalesce(con.category, p.category) AS category, coalesce(con.area, p.area) AS area, coalesce(con.cell, p.cell) AS cell, CASE WHEN con.cell IS NOT NULL THEN 'today' ELSE 'carried' END AS origin
FROM (SELECT * FROM con WHERE area::INT % 3 > 0) con FULL JOIN p USING (chart, category, area) WHERE (status IS NULL OR status <> 'disputed') AND coalesce(con.cell, p.cell) IS NOT NULL""")
def carry_forward_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    today = C.consensus(r).where(F.col("area").cast("int") % 3 > 0)
    before = r.where(F.col("area").cast("int") % 2 == 0).select(*C.KEY, F.lit("U").alias("cell")).distinct()
    return C.carry_forward(today, before)


@query("SELECT l_orderkey, max(l_shipdate)::DATE AS version, arg_max(l_suppkey, (l_shipdate, l_linenumber, l_suppkey)) AS supplier FROM lineitem GROUP BY l_orderkey")
def version_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_shipdate", "l_linenumber", "l_suppkey").alias("v"), "l_suppkey", F.to_date("l_shipdate").alias("version"))
    return C.newest(li, ["l_orderkey"], "v").select("l_orderkey", "version", F.col("l_suppkey").alias("supplier"))


_BLOCK_LIST = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '\n(\s*(?:[-*•]|\d+\.))', chr(1) || '\1', 'g'), chr(1)), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '')"""


@query(f"WITH b AS (SELECT doc_id, lang AS section, unnest({_BLOCK_LIST}) AS paragraph FROM documents) SELECT section, paragraph FROM b n WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id % 2 = 0 AND o.section = n.section AND o.paragraph = n.paragraph)")
def edition_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole paragraphs of the odd documents that no even document of their language has."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("section"), F.explode(T.blocks(F.col("text"))).alias("text")).withColumn("paragraph", F.sha2("text", 256))
    return V.edition_diff(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")).select("section", F.col("text").alias("paragraph"))


@query("SELECT lang AS section, text AS paragraph FROM documents n WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND o.lang = n.lang AND o.text = n.text)")
def edition_diff_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts compared, by digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("section"), F.sha2("text", 256).alias("paragraph"), "text")
    return V.edition_diff(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")).select("section", F.col("text").alias("paragraph"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as definitions, labels as what was built."""
    built = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("shard"))
    return registry.missing(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug")), built).select(F.col("slug").alias("doc_id"))


@query("""WITH p AS (SELECT doc_id AS id, doc_id % 4 AS title, doc_id % 3 AS sec, CASE doc_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['f'] WHEN 2 THEN ['f', '5'] WHEN 3 THEN ['f', '5', 'i'] ELSE ['m'] END::VARCHAR[] AS parts, text || CASE WHEN doc_id % 2 = 0 THEN ' (5) Duration' ELSE ' (f) Students' END AS text FROM documents),
v AS (SELECT item_id AS entry, least(item_id % 4, 2) AS title, item_id % 3 AS sec, CASE item_id % 7 WHEN 0 THEN [] WHEN 1 THEN ['f'] WHEN 2 THEN ['f', '5'] WHEN 3 THEN ['f', '6'] WHEN 4 THEN ['m'] WHEN 5 THEN ['f', '5', 'ii'] ELSE ['f', '5', 'i'] END::VARCHAR[] AS parts FROM benchmark)
SELECT id, entry FROM p JOIN v ON p.title = v.title AND p.sec = v.sec
WHERE p.title < 3 AND p.parts[1:least(len(p.parts), len(v.parts))] = v.parts[1:least(len(p.parts), len(v.parts))]
AND (len(v.parts) <= len(p.parts) OR regexp_matches(text, '\\(' || v.parts[len(p.parts) + 1] || '\\)\\s*[A-Z(]'))""")
def citation_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items as passages and provisions: four spellings of titles (one unreadable), three sections, paths of parts."""

    def cite(k: str, parts: list[str], names: list[str]) -> Column:
        section = F.concat((F.col(k) % 3 + 1).cast("string"), F.lit("a.2"))
        head = F.get(F.array(*map(F.lit, names)), (F.col(k) % 4).cast("int"))
        return F.concat(head, section, F.get(F.array(*map(F.lit, parts)), (F.col(k) % len(parts)).cast("int")))

    text = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " (5) Duration").otherwise(" (f) Students"))
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), cite("doc_id", ["", "(f)", "(f)(5)", "(f)(5)(i)", "(m)"], ["8 CFR § ", "20 C.F.R. § ", "22 CFR ", "no citation "]).alias("citation"), text.alias("text"))
    v = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), cite("item_id", ["", "(f)", "(f)(5)", "(f)(6)", "(m)", "(f)(5)(ii)", "(f)(5)(i)"], ["8 C.F.R. ", "20 CFR § ", "22 CFR § ", "22 CFR § "]).alias("provision"))
    return V.covering(p, v).select("id", "entry")


@query("""WITH s AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 * (1 + event_id % 48) AS b FROM events),
n AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, min(a) AS a, max(b) AS b FROM i GROUP BY user_id, island""")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.unix_timestamp(F.col("ts"))
    s = table(spark, sf_dir, "events").select("user_id", a.alias("a"), (a + 3600 * (1 + F.col("event_id") % 48)).alias("b"))
    return V.merged_spans(s, "user_id").select("user_id", "a", "b")


_DENSE = "regexp_replace({t}, '\\s', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id AS id, {_DENSE.format(t='text')} AS t FROM documents), b AS (SELECT item_id, {_DENSE.format(t='text')} AS p FROM benchmark),
hit AS (SELECT id, item_id FROM d JOIN b ON item_id % 4 = id % 4 AND (contains(t, left(p, 90)) OR contains(t, right(p, 90))))
SELECT id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS entries FROM hit GROUP BY id""")
def redact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as the amended paragraphs of register entries, cut out of the documents that cite their section."""
    cite = lambda k: F.concat(F.lit("8 CFR § 214."), (F.col(k) % 4 + 1).cast("string"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), cite("doc_id").alias("citation"), F.concat(cite("doc_id"), F.lit("\n"), "text").alias("text"))
    register = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("entry"), F.array(F.concat(cite("item_id"), F.lit("(f)"))).alias("provisions"), F.array("text").alias("amended"), F.lit("A v. B").alias("case_name"), F.lit("No. 1").alias("docket"))
    red = V.redacted(d, register).where("size(entries) > 0")
    return red.select("id", F.array_join(F.transform(F.array_sort("entries"), lambda e: e.cast("string")), ",").alias("entries"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 2 == 0).alias("cpt"), F.when(k % 5 != 0, (k % 20).cast("double")).alias("months"), (k % 3 == 0).alias("unemp"),
        F.when(k % 7 != 0, F.array((k % 100).cast("double"), (k % 60).cast("double"))).alias("days"), F.when(k % 11 != 0, k % 4 == 0).alias("stem"),
    )


_FACTS = "f AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS cpt, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 20 END AS months, o_orderkey % 3 = 0 AS unemp, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 100 END AS d1, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 60 END AS d2, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4 = 0 END AS stem FROM orders)"


@query(f"""WITH {_FACTS} SELECT o_orderkey, 'cpt_full_time_year' AS rule, CASE WHEN months IS NULL THEN 'needs' ELSE 'outcome' END AS kind, months >= 12 AS hit FROM f WHERE cpt
UNION ALL SELECT o_orderkey, 'unemployment_limit', CASE WHEN d1 IS NULL OR stem IS NULL THEN 'needs' ELSE 'outcome' END, CASE WHEN d1 IS NOT NULL AND stem IS NOT NULL THEN d1 + d2 > CASE WHEN stem THEN 150 ELSE 90 END END FROM f WHERE unemp OR d1 IS NOT NULL""")
def rule_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    results = R.evaluate(R.training_limit(F.col("cpt"), F.col("months")), R.unemployment(F.col("unemp"), F.col("days"), F.col("stem")))
    x = f.select("o_orderkey", F.explode(results).alias("r")).select("o_orderkey", "r.*")
    hit = F.when(F.col("kind") == "outcome", F.col("decision").startswith("INELIGIBLE") | F.col("decision").startswith("OVER"))
    return x.select("o_orderkey", "rule", "kind", hit.alias("hit"))


@query(f"WITH {_FACTS} SELECT fact, count(*) AS n FROM (SELECT 'cpt_full_time_months' AS fact FROM f WHERE cpt AND months IS NULL UNION ALL SELECT CASE WHEN d1 IS NULL THEN 'unemployment_days' ELSE 'stem_extension' END FROM f WHERE (unemp OR d1 IS NOT NULL) AND (d1 IS NULL OR stem IS NULL)) GROUP BY fact")
def rule_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = R.evaluate(R.training_limit(F.col("cpt"), F.col("months")), R.unemployment(F.col("unemp"), F.col("days"), F.col("stem")))
    return _facts(spark, sf_dir).select(F.explode(results).alias("r")).where("r.kind = 'needs'").groupBy(F.col("r.fact").alias("fact")).agg(F.count("*").alias("n"))


@query(f"WITH {_FACTS} SELECT o_orderkey, (d1 + d2)::DOUBLE AS used, d1 || ' + ' || d2 || ' = ' || (d1 + d2) AS shown FROM f WHERE d1 IS NOT NULL")
def unemployment_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("days")
    shown = F.concat(F.array_join(F.transform(d, R.general), " + "), F.lit(" = "), R.general(R.used_days(d)))
    return _facts(spark, sf_dir).where("days is not null").select("o_orderkey", R.used_days(d).alias("used"), shown.alias("shown"))


_ASK = (
    "My change of status is pending, can I travel abroad?", "I filed my STEM extension on time but my EAD expired", "Is my priority date current for EB-2?", "It was approved.",
    "My COS has not been decided and I have no decision, so a trip must wait", "The STEM application is pending. My OPT card ran out", "It was denied but not yet mailed", "visa bulletin cut-off date, timely", "none of these words",
)
# RE2 has no look-ahead: a decision counts unless "yet" follows it in its sentence
_SAYS = {k: f"regexp_matches(q, '(?i){rx}')" for k, rx in R.SITUATIONS.items() if k != "says_decided"} | {"says_decided": r"regexp_matches(q, '(?i)\b(approved|denied|rejected)\b') AND NOT regexp_matches(q, '(?i)\b(approved|denied|rejected)\b[^.]{0,20}\byet\b')"}
_ASKED = "SELECT conv_id, turn, text || '. ' || [" + ", ".join(f"'{q}'" for q in _ASK) + f"][(conv_id * 2 + turn) % {len(_ASK)} + 1] AS q FROM conversations"


@query(" UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS says FROM ({_ASKED}) WHERE {c}" for k, c in _SAYS.items()))
def read_situation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every turn of every conversation says, with one of the questions after it."""
    asked = F.get(F.array(*map(F.lit, _ASK)), ((F.col("conv_id") * 2 + F.col("turn")) % len(_ASK)).cast("int"))
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(". "), asked).alias("q"))
    said = F.array_compact(F.array(*[F.when(c, k) for k, c in R.situation(F.col("q")).items()]))
    return x.select("conv_id", "turn", F.explode(said).alias("says"))


#: fact, reply and value as SQL over n = o_orderkey and d, a date
_REPLIES = (
    ("cpt_full_time_months", "'a full year'", "'12'"), ("cpt_full_time_months", "n % 30 || ' months'", "(n % 30)::VARCHAR"), ("cpt_full_time_months", "'none'", "'0'"), ("cpt_full_time_months", "'between 3 and 6'", "NULL"),
    ("unemployment_days", "'twenty-four, then ' || (100 + n % 30) || ' days'", "'24,' || (100 + n % 30)"), ("stem_extension", "'yes I am'", "'true'"), ("stem_extension", "'Nope'", "'false'"), ("stem_extension", "'maybe'", "NULL"),
    ("eb_category", "'EB-' || (1 + n % 4) || ' I think'", "'EB-' || (1 + n % 4)"), ("eb_category", "'EB-1 or EB-2'", "NULL"), ("country_of_birth", "' India '", "'India'"), ("priority_date", "strftime(d, '%-d %B %Y')", "strftime(d, '%Y-%m-%d')"),
    ("priority_date", "strftime(d, '%Y-%m-%d')", "strftime(d, '%Y-%m-%d')"), ("priority_date", "'2021-02-30'", "NULL"), ("cos_pending", "''", "NULL"), ("stem_timely", "'it is'", "'true'"),
)
_REPLY_CASE = lambda i: "CASE n % 16 " + " ".join(f"WHEN {k} THEN {r[i]}" for k, r in enumerate(_REPLIES)) + " END"


@query("SELECT o_orderkey, CASE n % 16 " + " ".join(f"WHEN {k} THEN '{r[0]}'" for k, r in enumerate(_REPLIES)) + f" END AS fact, {_REPLY_CASE(1)} AS reply, {_REPLY_CASE(2)} AS value FROM (SELECT o_orderkey, o_orderkey AS n, o_orderdate::DATE AS d FROM orders)")
def reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply to some question for every order; values follow from how the reply was made."""
    forms = {"strftime(d, '%-d %B %Y')": "date_format(d, 'd MMMM yyyy')", "strftime(d, '%Y-%m-%d')": "date_format(d, 'yyyy-MM-dd')"}
    fact = "CASE n % 16 " + " ".join(f"WHEN {k} THEN '{r[0]}'" for k, r in enumerate(_REPLIES)) + " END"
    reply = "CASE n % 16 " + " ".join(f"WHEN {k} THEN {forms.get(r[1], r[1])}" for k, r in enumerate(_REPLIES)) + " END"
    d = _orders(spark, sf_dir).withColumn("n", F.col("o_orderkey")).select("o_orderkey", F.expr(fact).alias("fact"), F.expr(reply).alias("reply"))
    return d.select("o_orderkey", "fact", "reply", R.reply_value(F.col("fact"), F.col("reply")).alias("value"))


_STATUS = """f AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS cos, o_orderkey % 3 > 0 AS travel, o_orderkey % 5 > 1 AS pending, o_orderkey % 7 = 0 AS decided, o_orderkey % 4 < 3 AS filed, o_orderkey % 11 < 5 AS expired, o_orderkey % 13 > 3 AS timely,
CASE WHEN o_orderkey % 6 > 0 THEN 'EB-2' END AS category, CASE WHEN o_orderkey % 8 > 0 THEN 'india' END AS area, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate::DATE END AS priority, CASE o_orderkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'U' WHEN 2 THEN '1996-01-01' END AS action FROM orders)"""


@query(f"""WITH {_STATUS} SELECT k AS o_orderkey, 'cos_travel_abandonment' AS rule, CASE WHEN NOT pending OR decided THEN 'cos_pending' END AS fact, CASE WHEN pending AND NOT decided THEN 'ABANDONS' END AS word FROM f WHERE cos AND travel
UNION ALL SELECT k, 'stem_pending_work', CASE WHEN decided THEN 'stem_decided' WHEN NOT timely THEN 'stem_timely' END, CASE WHEN NOT decided AND timely THEN 'MAY' END FROM f WHERE filed AND (expired OR pending)
UNION ALL SELECT k, 'priority_date_current', CASE WHEN category IS NULL THEN 'eb_category' WHEN area IS NULL THEN 'country_of_birth' WHEN priority IS NULL THEN 'priority_date' END,
  CASE WHEN category IS NOT NULL AND area IS NOT NULL AND priority IS NOT NULL THEN CASE WHEN action IS NULL THEN 'UNCONFIRMED' WHEN action = 'C' THEN 'CURRENT' WHEN action = 'U' THEN 'NOT' WHEN priority < TRY_CAST(action AS DATE) THEN 'CURRENT' ELSE 'NOT' END END FROM f""")
def status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Travel and work while pending, and priority dates, for a person an order: the fact still needed or the word that decides."""
    k = F.col("o_orderkey")
    action = F.when(k % 4 == 0, "C").when(k % 4 == 1, "U").when(k % 4 == 2, "1996-01-01")
    x = _orders(spark, sf_dir).select(
        "o_orderkey", (k % 2 == 0).alias("cos"), (k % 3 > 0).alias("travel"), (k % 5 > 1).alias("pending"), (k % 7 == 0).alias("decided"), (k % 4 < 3).alias("filed"), (k % 11 < 5).alias("expired"), (k % 13 > 3).alias("timely"),
        F.when(k % 6 > 0, "EB-2").alias("category"), F.when(k % 8 > 0, "india").alias("area"), F.when(k % 9 > 0, F.col("d")).alias("priority"), action.alias("action"), "d",
    )
    c = F.col
    results = R.evaluate(
        R.travel_pending(c("cos"), c("travel"), c("pending"), c("decided")),
        R.work_pending(c("filed"), c("expired"), c("pending"), c("decided"), c("timely"), c("d")),
        R.priority_date(F.lit(True), c("category"), c("area"), c("priority"), c("action"), F.lit("C"), F.lit("June 1996")),
    )
    x = x.select("o_orderkey", F.explode(results).alias("r")).select("o_orderkey", "r.*")
    return x.select("o_orderkey", "rule", "fact", F.nullif(F.regexp_extract("decision", r"(?:Final Action Dates: |\b)(ABANDONS|MAY|UNCONFIRMED|CURRENT|NOT)\b", 1), F.lit("")).alias("word"))
