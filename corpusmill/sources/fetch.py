"""Fetching through a client function, landing what came, and guarded refresh.

A client is any picklable function from a url to (status, body); a failure may also
raise. Requests run on executors, a row each, and never fail a job: what went wrong is
a column. ``folder`` is a client over files, for tests and for mirrors that were carried
in by hand; a network client has the same shape and is given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusmill.plans.staging import cut
from corpusmill.sources import landing as L

Client = Callable[[str], tuple[int, bytes]]
#: name, new body, body so far (or None) -> what is wrong with the new one, '' for nothing
Check = Callable[[str, bytes, bytes | None], str]

RAW = "source string, name string, url string, content binary, sha256 string, bytes long, fetched timestamp"


def folder(root: str) -> Client:
    """A client over files named by their quoted url; ``<file>.status`` may hold another status than 200."""

    def get(url: str) -> tuple[int, bytes]:
        f = Path(root) / quote(url, safe="")
        code = Path(f"{f}.status")
        return int(code.read_text()) if code.exists() else 200 if f.exists() else 404, f.read_bytes() if f.exists() else b""

    return get


def with_fallback(first: Client, second: Client) -> Client:
    """The second client where the first cannot connect or is turned away."""

    def get(url: str) -> tuple[int, bytes]:
        try:
            status, body = first(url)
        except OSError:
            return second(url)
        return second(url) if status in L.RETRY_STATUS else (status, body)

    return get


def fetched(requests: DataFrame, client: Client) -> DataFrame:
    """``requests`` (with url) plus status, content and problem, '' where all went well."""
    names = [f.name for f in requests.schema if f.name not in ("status", "content", "problem")]
    schema = requests.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, url in enumerate(b.column("url").to_pylist()):  # a body at a time
                status, body, problem = None, None, "no url"
                if url:
                    try:
                        status, body = client(url)
                        problem = "" if status == 200 else f"status {status}"
                    except Exception as e:
                        problem = f"{type(e).__name__}: {e}"
                row = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([status], pa.int32()), pa.array([None if problem else body], pa.binary()), pa.array([problem], pa.string())], names=[*row.schema.names, "status", "content", "problem"]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return requests.select(*names).mapInArrow(run, f"{kinds}, status int, content binary, problem string")


def dated(url: Column, edition: Column) -> Column:
    """A url with the edition's date filled in."""
    return F.replace(url, F.lit("{date}"), F.coalesce(edition.cast("string"), F.lit("")))


def file_name(url: Column, declared: Column, content: Column, otherwise: Column) -> Column:
    """The last step of the url's path, with the suffix that the body calls for."""
    stem = F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1), F.lit("")), otherwise)
    suffix = L.sniffed(declared, content)
    return F.when(stem.endswith(suffix), stem).otherwise(F.concat(stem, suffix))


def land(got: DataFrame, path: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Write the bodies of ``got`` (source, declared, url, content, problem) as a raw table; (manifest, rejects).

    Each source's partition is replaced if anything came for it. Members of zip files are
    rows of their own.
    """
    got = cut(got)
    whole = got.where("problem = ''").withColumn("name", file_name(F.col("url"), F.col("declared"), F.col("content"), F.col("source")))
    zipped = F.col("name").endswith(".zip")
    packed = whole.where(zipped)
    members = L.zip_members(packed.select(F.concat_ws("\n", "source", "url").alias("path"), "content"))
    parts = F.split("path", "[\n]")
    inner = F.regexp_extract("path", r"!(?:.*/)?([^/]+)$", 1)
    members = members.select(F.get(parts, 0).alias("source"), inner.alias("name"), F.regexp_replace(F.get(parts, 1), r"![^!]*$", "").alias("url"), "content")
    rows = whole.where(~zipped).select("source", "name", "url", "content").unionByName(members)
    rows = rows.select("source", "name", "url", "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), F.lit(now).cast("timestamp").alias("fetched"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    return raw(got.sparkSession, path).drop("content"), got.where("problem != ''").select("source", "url", "status", "problem")


def raw(spark: SparkSession, path: str) -> DataFrame:
    """The landed table, empty if nothing was landed yet."""
    try:
        return spark.read.schema(RAW).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RAW)


def refresh(spark: SparkSession, items: DataFrame, path: str, client: Client, check: Check, now: str, shipped: DataFrame | None = None, force: bool = False) -> DataFrame:
    """(name, status, detail) of a conditional refresh of ``items`` (name, url) in the table under ``path``.

    An item without url is skipped, one checked within the limit is left alone; what
    cannot be fetched or fails ``check`` against the current copy (or the ``shipped`` one)
    keeps that copy; equal bytes only renew the time. Names are partitions, so an item
    is replaced whole or not at all.
    """
    kept = cut(raw(spark, path).select(F.col("source").alias("name"), F.col("content").alias("old"), "fetched"))
    age = (F.lit(now).cast("timestamp").cast("long") - F.col("fetched").cast("long")) / 3600
    x = items.select("name", "url").join(kept, "name", "left").withColumn("age_hours", age)
    if shipped is not None:
        x = x.join(shipped.select("name", F.col("content").alias("other")), "name", "left").withColumn("against", F.coalesce("old", "other"))
    else:
        x = x.withColumn("against", F.col("old"))
    due = (F.coalesce("url", F.lit("")) != "") & (F.lit(force) | F.col("age_hours").isNull() | (F.col("age_hours") >= L.TTL_HOURS))
    got = fetched(x.where(due).select("name", "url"), client).select("name", "content", "problem")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, new, old in zip(b.column("name").to_pylist(), b.column("content"), b.column("against")):
                if not new.is_valid:
                    out.append(None)
                    continue
                try:
                    why = check(name, new.as_py(), old.as_py())
                    out.append(f"rejected: {why}" if why else "")
                except Exception as e:
                    out.append(f"rejected: {type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.string())], names=["name", "verdict"])

    got = cut(got)
    verdicts = got.join(x.select("name", "against"), "name").select("name", "content", "against").mapInArrow(judge, "name string, verdict string")
    x = x.join(got, "name", "left").join(verdicts, "name", "left")
    x = x.withColumn("problem", F.coalesce(F.nullif("problem", F.lit("")), F.nullif("verdict", F.lit("")), F.lit(""))).withColumn("same", F.coalesce(F.col("content") == F.col("old"), F.lit(False)))
    done = cut(L.refresh_status(x, force))
    fresh = done.where("status = 'updated' or status = 'unchanged' and content is not null")
    fresh = fresh.select(F.col("name").alias("source"), "name", "url", "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), F.lit(now).cast("timestamp").alias("fetched"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    return done.select("name", "status", F.when(F.col("status") == "kept", F.col("problem")).otherwise("").alias("detail"))
