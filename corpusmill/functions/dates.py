"""Dates in cells and prose, spellings, windows and their status. ``today`` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date grammar and window lengths.
ISO = r"\b(20\d\d-\d\d-\d\d)\b"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
PROSE = rf"(?i)\b({MONTHS}|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(20\d\d)\b"
FILE_BEFORE, FILE_AFTER, GRACE, DRIFT, WORK_AFTER = 90, 60, 60, 3, 180
LIMIT, STEM_LIMIT = 90, 150


def month_number(name: Column) -> Column:
    """1-12 from a month's first three letters; null otherwise."""
    at = F.position(F.lower(F.substring(name, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return F.when((F.length(name) >= 3) & (at > 0) & ((at - 1) % 3 == 0), F.floor((at - 1) / 3).cast("int") + 1)


def date_from(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.try_cast("int"), m.try_cast("int"), d.try_cast("int")), "yyyy-MM-dd")


def parse_cell(cell: Column) -> Column:
    """'01JUN23' or 'June 1, 2023' -> ISO date; Current -> C; Unavailable -> U; else null."""
    c = F.trim(F.regexp_replace(F.trim(cell), r"\*+$", ""))
    u = F.upper(c)
    part = lambda rx, k: F.nullif(F.regexp_extract(c, rx, k), F.lit(""))
    short = r"^(\d{2})([A-Za-z]{3})(\d{2})$"
    compact = date_from(part(short, 3).try_cast("int") + 2000, month_number(part(short, 2)), part(short, 1))
    long = rf"^(?i)({MONTHS}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\.?),?\s+(\d{{1,2}}),?\s+(\d{{4}})$"
    prose = date_from(part(long, 3), month_number(part(long, 1)), part(long, 2))
    return F.when(u.isin("C", "CURRENT"), "C").when(u.isin("U", "UNAVAILABLE", "UNAUTHORIZED"), "U").otherwise(F.date_format(F.coalesce(compact, prose), "yyyy-MM-dd"))


def compare(priority: Column, cutoff: Column) -> Column:
    """CURRENT only if strictly earlier than the cut-off; a missing cell is unconfirmed."""
    return (
        F.when(cutoff.isNull(), "UNCONFIRMED")
        .when(cutoff == "C", "CURRENT")
        .when(cutoff == "U", "NOT CURRENT")
        .when(priority < F.try_to_date(cutoff, "yyyy-MM-dd"), "CURRENT")
        .otherwise("NOT CURRENT")
    )


def timing(month: Column, today: Column) -> Column:
    m, t = F.trunc(month, "MM"), F.trunc(today, "MM")
    return F.when(m == t, "current").when(m > t, "upcoming").otherwise("stale")


def dates_in(text: Column) -> Column:
    """array<struct<raw, d>> of the dates a text states, ISO first, then prose; no such day, no date."""
    iso = F.transform(F.regexp_extract_all(text, F.lit(ISO), 1), lambda x: F.struct(x.alias("raw"), F.try_to_date(x, "yyyy-MM-dd").alias("d")))

    def prose_date(x: Column) -> Column:
        mon, day, year = (F.regexp_extract(x, PROSE, k) for k in (1, 2, 3))
        return F.struct(F.concat(mon, F.lit(" "), day, F.lit(", "), year).alias("raw"), date_from(year, month_number(mon), day).alias("d"))

    prose = F.transform(F.regexp_extract_all(text, F.lit(PROSE), 0), prose_date)
    return F.filter(F.concat(iso, prose), lambda s: s["d"].isNotNull())


def date_of(text: Column) -> Column:
    """The full date a person wrote: ISO first (an impossible one gives null), else the
    first readable prose date, month before day or day before month."""
    iso = F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z]{3,9}\.? \d{1,2},? \d{4}|\d{1,2} [A-Za-z]{3,9}\.? \d{4}"), 0)

    def read(x: Column) -> Column:
        a, b = r"^([A-Za-z]+)\.? (\d{1,2}),? (\d{4})$", r"^(\d{1,2}) ([A-Za-z]+)\.? (\d{4})$"
        return F.coalesce(date_from(F.regexp_extract(x, a, 3), month_number(F.regexp_extract(x, a, 1)), F.regexp_extract(x, a, 2)), date_from(F.regexp_extract(x, b, 3), month_number(F.regexp_extract(x, b, 2)), F.regexp_extract(x, b, 1)))

    prose = F.get(F.filter(F.transform(found, read), lambda d: d.isNotNull()), 0)
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).otherwise(prose)


def forms(d: Column) -> Column:
    """The six spellings a source may use for a day."""
    return F.array(*[F.date_format(d, p) for p in ("yyyy-MM-dd", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "M/d/yyyy", "MM/dd/yyyy")])


def supported(d: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.exists(forms(d), lambda f: low.contains(F.lower(f)))


def window(name: str | Column, opens: Column, closes: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), opens.cast("date").alias("opens"), closes.cast("date").alias("closes"))


def filing_windows(program_end: Column) -> Column:
    return F.array(window("filing", F.date_sub(program_end, FILE_BEFORE), F.date_add(program_end, FILE_AFTER)), window("grace", F.date_add(program_end, 1), F.date_add(program_end, GRACE)))


def extension_window(end: Column) -> Column:
    return window("extension", F.date_sub(end, FILE_BEFORE), end)


def grace_window(end: Column) -> Column:
    return window("grace after work", F.date_add(end, 1), F.date_add(end, GRACE))


def allowance(start: Column, stem: Column) -> Column:
    return window(F.concat(F.lit("allowance "), F.when(stem, STEM_LIMIT).otherwise(LIMIT)), start, F.lit(None))


def gap_window(fiscal_year: Column) -> Column:
    return window("gap", F.make_date(fiscal_year - 1, F.lit(4), F.lit(1)), F.make_date(fiscal_year - 1, F.lit(9), F.lit(30)))


def fiscal_year_of_gap(today: Column) -> Column:
    fy = F.year(today) + F.when(F.month(today) >= 10, 1).otherwise(0)
    return fy + F.when(F.month(today) >= 4, 1).otherwise(0)


def windows(status: Column, program_end: Column, opt_start: Column, opt_end: Column, stem: Column, filed: Column, today: Column) -> Column:
    """Every window the stated facts allow to be computed; unparsable dates are absent."""
    student = F.coalesce(F.upper(status).startswith("F"), F.lit(False))
    none = F.filter(filing_windows(F.current_date()), lambda x: F.lit(False))
    return F.concat(
        F.when(student & program_end.isNotNull(), filing_windows(program_end)).otherwise(none),
        F.when(opt_end.isNotNull(), F.array(extension_window(opt_end), grace_window(opt_end))).otherwise(none),
        F.when(opt_start.isNotNull(), F.array(allowance(opt_start, F.coalesce(stem, F.lit(False))))).otherwise(none),
        F.when(student & F.coalesce(filed, F.lit(False)), F.array(gap_window(fiscal_year_of_gap(today)))).otherwise(none),
    )


def status(opens: Column, closes: Column, today: Column) -> Column:
    """Inclusive bounds; a missing bound is open."""
    days = lambda a, b: F.datediff(a, b).cast("string")
    return (
        F.when(opens.isNotNull() & (today < opens), F.concat(F.lit("opens in "), days(opens, today), F.lit(" days")))
        .when(closes.isNotNull() & (today > closes), F.concat(F.lit("CLOSED "), days(today, closes), F.lit(" days ago")))
        .when(closes.isNotNull(), F.concat(F.lit("OPEN — "), days(closes, today), F.lit(" days remaining")))
        .otherwise("open")
    )


def age(fetched: Column, today: Column) -> Column:
    return F.coalesce(F.datediff(today, fetched), F.lit(9999))


def stale(fetched: Column, refresh_days: Column, today: Column) -> Column:
    """Strictly older than the limit; a missing date is as old as can be."""
    return age(fetched, today) > refresh_days


def area_of(country: Column) -> Column:
    c = F.lower(F.trim(country))
    return (
        F.when(c == "", F.lit(None).cast("string"))
        .when(c.rlike("hong kong|macau|macao|taiwan"), "all")
        .when(c.rlike(r"china|\bprc\b"), "china")
        .when(c.rlike("india"), "india")
        .when(c.rlike("mexic"), "mexico")
        .when(c.rlike("philippin|filipin"), "philippines")
        .otherwise("all")
    )


def shown(w: Column, today: Column) -> Column:
    """name: opens → closes  [status] of one window."""
    day = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("—"))
    return F.concat(w["name"], F.lit(": "), day(w["opens"]), F.lit(" → "), day(w["closes"]), F.lit("  ["), status(w["opens"], w["closes"], today), F.lit("]"))


def render(ws: Column, today: Column) -> Column:
    """The block of computed deadlines, or '' without windows."""
    head = F.concat(F.lit("COMPUTED DEADLINES (today = "), F.date_format(today, "yyyy-MM-dd"), F.lit("):\n  "))
    return F.when(F.size(ws) > 0, F.concat(head, F.array_join(F.transform(ws, lambda w: shown(w, today)), "\n  "))).otherwise("")
