"""Corpus definitions and settings from TOML files (small, read by the driver)."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "slug string, title string, tier int, fetcher string, chunker string, url string, urls array<string>, jurisdiction string, kind string, refresh_days int, private boolean, note string"
_DEFAULTS = {"title": "", "tier": 3, "fetcher": "http", "chunker": "text", "url": "", "urls": [], "jurisdiction": "", "kind": "", "refresh_days": 30, "private": False, "note": ""}


def load(spark: SparkSession, folder: str) -> DataFrame:
    """One row a definition, by tier and slug. Unknown keys are refused; the slug
    defaults to the file's name."""
    rows = []
    for f in sorted(Path(folder).glob("*.toml")):
        raw = {"slug": f.stem, **tomllib.loads(f.read_text())}
        if unknown := set(raw) - set(_DEFAULTS) - {"slug"}:
            raise ValueError(f"{f.name}: unknown keys {sorted(unknown)}")
        rows.append(tuple({**_DEFAULTS, **raw}[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(rows, SCHEMA).orderBy("tier", "slug")


def lookup(defs: DataFrame, slug: str) -> DataFrame:
    return defs.where(F.col("slug") == slug).limit(1)


def missing(defs: DataFrame, shards: DataFrame) -> DataFrame:
    """Definitions without a built shard."""
    return defs.join(shards.select("shard").distinct(), defs["slug"] == F.col("shard"), "left_anti")


def load_profile(path: str) -> dict:
    """A flat map; a file that cannot be read is an empty profile."""
    try:
        return tomllib.loads(Path(path).read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return {}


def known(profile: dict) -> dict:
    """Fields that say something: not empty, None, False or 0."""
    return {k: v for k, v in profile.items() if v not in ("", None, False)}


def set_value(path: str, key: str, value: object) -> dict:
    """Upsert one field; unknown keys stay; "true"/"false" become booleans."""
    p = load_profile(path)
    p[key] = {"true": True, "false": False}.get(value.lower(), value) if isinstance(value, str) else value
    Path(path).write_text("".join(f"{k} = {toml_value(v)}\n" for k, v in p.items()))
    return p


def toml_value(v: object) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(toml_value, v)) + "]"
    return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
