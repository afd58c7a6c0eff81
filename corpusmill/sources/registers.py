"""Register and chart files (TOML): read, and checked before they replace a local copy."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.validity import CITE

REGISTER = "entry int, provisions array<string>, amended array<string>, status string, case_name string, docket string, court string, order_date date, scope string, rule string, instead string, not_covered string, source_url string, checked date"
CELL = r"(C|U|\d{4}-\d{2}-\d{2})"


def entries(text: str) -> list[tuple]:
    """Rows of ``REGISTER``, numbered from 1 in the order of the file."""
    texts = ("instead", "not_covered", "source_url")
    return [
        (n, list(e.get("provisions", [])), list(e.get("amended", [])), e.get("status"), e.get("case"), e.get("docket"), e.get("court"), e.get("order_date"), e.get("scope"), e.get("rule"), *(e.get(k) for k in texts), e.get("checked"))
        for n, e in enumerate(tomllib.loads(text).get("entry", []), 1)
    ]


def read_register(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(entries(text), REGISTER)


def _register_problem(new: str, old: str | None) -> str:
    rows = entries(new)
    if not rows:
        return "no entries"
    for n, provisions, *_ in rows:
        if not provisions:
            return f"no provisions in {n}"
        if not all(re.match(CITE, p) for p in provisions):
            return f"unreadable provisions in {n}"
    newest = lambda rs: max((str(r[-1] or "") for r in rs), default="")
    return "checked less recently than the local register" if old and newest(rows) < newest(entries(old)) else ""


def _chart_problem(new: str, old: str | None) -> str:
    d = tomllib.loads(new)
    month = str(d.get("month", ""))
    if not re.fullmatch(r"\d{4}-\d{2}", month):
        return "no month"
    cells = [(chart, category, area, cell) for chart, by in d.items() if isinstance(by, dict) for category, areas in by.items() if isinstance(areas, dict) for area, cell in areas.items()]
    for *place, cell in cells:
        if not re.fullmatch(CELL, str(cell)):
            return f"unreadable cell {'/'.join(place)}"
    if not cells:
        return "no chart"
    return "older than the local table" if old and month < str(tomllib.loads(old).get("month", "")) else ""


def accepts(name: str, new: bytes, old: bytes | None) -> str:
    """Why a fetched file may not replace the local one; '' where it may.

    The name says what it is: a register, a bulletin's charts, or any other file, which
    only must not be empty. A file that cannot be read is refused.
    """
    if "register" not in name and "bulletin" not in name:
        return "" if new else "empty"
    judge = _register_problem if "register" in name else _chart_problem
    try:
        text = new.decode()
    except UnicodeDecodeError as e:
        return f"no UTF-8: {e.reason}"
    try:
        before = old.decode() if old else None
        if before is not None:
            tomllib.loads(before)
    except (UnicodeDecodeError, tomllib.TOMLDecodeError):
        before = None  # a local copy that cannot be read holds nothing back
    try:
        return judge(text, before)
    except tomllib.TOMLDecodeError as e:
        return f"no TOML: {e}"
