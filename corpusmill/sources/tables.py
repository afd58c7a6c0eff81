"""HTML tables as long rows; cut-off charts unpivoted; the cube as TOML."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import dates as D
from corpusmill.functions import text as T
from corpusmill.sources.registry import toml_value

# Chart names, row labels and column headers of the cut-off charts.
CHARTS = ("final_action", "dates_for_filing")
ROWS = (
    ("other workers", "EB-3 other workers"),
    ("religious", "EB-4 religious workers"),
    (r"^(1st|eb-?1)\b", "EB-1"),
    (r"^(2nd|eb-?2)\b", "EB-2"),
    (r"^(3rd|eb-?3)\b", "EB-3"),
    (r"^(4th|eb-?4)\b", "EB-4"),
    (r"^(5th|eb-?5) unreserved", "EB-5 unreserved"),
)
AREAS = (
    ("china", "china"),
    ("india", "india"),
    ("mexico", "mexico"),
    ("philippines", "philippines"),
    ("all", r"all chargeability|all others|worldwide|rest of world|\brow\b"),
)
BEFORE, HEADING = 6000, 1500
CUBE = "month string, chart string, category string, area string, cell string"


def _first(c: Column, pairs: tuple) -> Column:
    out = F.lit(None).cast("string")
    for pattern, value in reversed(pairs):
        out = F.when(c.rlike(f"(?i){pattern}"), value).otherwise(out)
    return out


def cells(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, table_no, before, row, col, cell) of every table cell of every page."""
    parts = F.split(F.coalesce(F.col(html), F.lit("")), r"(?i)(?=<table[\s>])")
    x = pages.select(F.col(id_col).alias("id"), parts.alias("parts")).select("id", "parts", F.posexplode("parts").alias("n", "part")).where("n > 0")
    raw = F.array_join(F.slice("parts", F.lit(1), F.col("n")), "")
    before = T.visible(F.substring(raw, F.greatest(F.length(raw) - BEFORE + 1, F.lit(1)), F.lit(BEFORE)))
    body = F.regexp_extract("part", r"(?is)^<table.*?</table>", 0)
    x = x.select("id", F.col("n").alias("table_no"), before.alias("before"), F.posexplode(F.regexp_extract_all(body, F.lit(r"(?is)<tr.*?</tr>"), 0)).alias("row", "tr"))
    x = x.select("id", "table_no", "before", "row", F.posexplode(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)).alias("col", "cell"))
    return x.withColumn("cell", T.visible(F.col("cell")))


def chart_of(before: Column) -> Column:
    """The chart whose heading stands last before the table, or null."""
    b = F.upper(F.substring(before, F.greatest(F.length(before) - HEADING + 1, F.lit(1)), F.lit(HEADING)))
    at = lambda s: F.when(F.locate(s[::-1], F.reverse(b)) > 0, F.length(b) - F.locate(s[::-1], F.reverse(b)) - len(s) + 1).otherwise(-1)
    fa, df = at("FINAL ACTION"), F.greatest(at("DATES FOR FILING"), at("FILING DATES"))
    return F.when((fa < 0) & (df < 0), F.lit(None).cast("string")).when(fa > df, CHARTS[0]).otherwise(CHARTS[1])


def chart_cells(table_cells: DataFrame) -> DataFrame:
    """(id, table_no, chart, category, area, raw, cell) of the cut-off charts among tables.

    Unknown columns and rows drop out; an unreadable cell has a null ``cell``, so a
    strict caller can refuse it and a lenient one leave it out.
    """
    head = table_cells.where("row = 0 and col > 0").select("id", "table_no", "col", _first(F.col("cell"), tuple((rx, k) for k, rx in AREAS)).alias("area")).where("area is not null")
    kind = table_cells.where("row > 0 and col = 0").select("id", "table_no", "row", _first(F.trim("cell"), ROWS).alias("category")).where("category is not null")
    x = table_cells.where("row > 0 and col > 0").join(head, ["id", "table_no", "col"]).join(kind, ["id", "table_no", "row"])
    return x.select("id", "table_no", chart_of(F.col("before")).alias("chart"), "category", "area", F.col("cell").alias("raw"), D.parse_cell(F.col("cell")).alias("cell"))


def bulletin_month(page_text: Column) -> Column:
    m = F.regexp_extract(page_text, r"Visa Bulletin For ([A-Z][a-z]+ \d{4})", 1)
    return F.date_format(F.try_to_date(F.concat(F.lit("1 "), m), "d MMMM yyyy"), "yyyy-MM")


def read_cube(spark: SparkSession, toml: str) -> DataFrame:
    raw = tomllib.loads(toml)
    rows = [(raw["month"], chart, cat, area, str(v)) for chart in CHARTS for cat, r in raw.get(chart, {}).items() for area, v in r.items()]
    return spark.createDataFrame(rows, CUBE)


def to_toml(cube: list, month: str, method: str, sources: list[str]) -> str:
    """The cube (rows of chart, category, area, cell) as TOML; a chart has a few dozen cells."""
    lines = [f"month = {toml_value(month)}", f"method = {toml_value(method)}", f"sources = {toml_value(sorted(sources))}"]
    for chart in CHARTS:
        cats = sorted({r.category for r in cube if r.chart == chart})
        for cat in cats:
            lines += ["", f"[{chart}.{toml_value(cat)}]"]
            lines += [f"{r.area} = {toml_value(r.cell)}" for r in sorted((r for r in cube if r.chart == chart and r.category == cat), key=lambda r: r.area)]
    return "\n".join(lines) + "\n"


def cube_problems(new: DataFrame, old_month: str | None = None) -> DataFrame:
    """Violations of a cube (month, chart, category, area, cell): an empty result accepts it."""
    month_bad = ~F.col("month").rlike(r"^\d{4}-\d{2}$")
    problems = new.select(F.when(month_bad, F.lit("no month")).when(~F.col("cell").rlike(r"^(C|U|\d{4}-\d{2}-\d{2})$"), F.concat_ws("/", F.lit("unreadable cell"), "chart", "category", "area")).when(F.lit(old_month is not None) & (F.col("month") < F.lit(old_month or "")), F.lit("older than the local table")).alias("problem"))
    none = new.agg(F.when(F.count("*") == 0, F.lit("no chart")).alias("problem"))
    return problems.unionByName(none).where("problem is not null").distinct()


def first_per_chart(cells_: DataFrame) -> DataFrame:
    """Of several tables of one page and chart, the first counts."""
    first = cells_.groupBy("id", "chart").agg(F.min("table_no").alias("table_no"))
    return cells_.join(first, ["id", "chart", "table_no"], "left_semi")


def agency_chart(page: Column, month_label: str) -> Column:
    """The chart an agency's page names for a month, or null while it names none."""
    # The sentence of the filing-charts page.
    rx = r"For Employment-Based Preference Filings: For all employment-based preference categories, you must use the (Final Action Dates|Dates for Filing) chart in the Department of State Visa Bulletin for "
    m = F.regexp_extract(T.visible(page), rx + r"\Q" + month_label + r"\E", 1)
    return F.when(m.startswith("Final"), CHARTS[0]).when(m != "", CHARTS[1])


def publisher_cells(pages: DataFrame, month_label: str) -> DataFrame:
    """(source, chart, category, area, cell) of landed publisher pages (source, html).

    A page that does not name the month does not vote; unreadable cells drop out.
    """
    ok = pages.where(F.lower(T.visible(F.col("html"))).contains(month_label.lower()))
    x = first_per_chart(chart_cells(cells(ok, "source")).where("chart is not null"))
    return x.where("cell is not null").select(F.col("id").alias("source"), "chart", "category", "area", "cell")


def merged_sources(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_union(a, b)))
