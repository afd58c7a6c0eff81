"""Landing raw files: sniffing, digests, archive members, guarded refresh.

What was fetched is a table (path, content) as read by the ``binaryFile`` source or
landed by ``fetch``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TTL_HOURS = 24
TEXT_SUFFIXES = (".md", ".txt", ".html", ".htm", ".xml", ".pdf")
RETRY_STATUS = (403, 406, 429)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content", "length", "modificationTime")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def by_source(spark: SparkSession, path: str) -> DataFrame:
    """(source, path, content) of the files in a folder of folders named by source."""
    f = files(spark, f"{path.rstrip('/')}/*/*")
    return f.select(F.element_at(F.split("path", "/"), -2).alias("source"), "path", "content")


def sniffed(declared: Column, content: Column) -> Column:
    """Extension of a body: PDF magic beats what was declared."""
    head = F.substring(content, 1, 5)
    return F.when(head == F.lit(b"%PDF-"), ".pdf").when(declared.isin("ecfr", "xml"), ".xml").when(declared == "zip", ".zip").otherwise(".html")


def manifest(raw: DataFrame) -> DataFrame:
    """name, sha256, bytes of every landed file."""
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def zip_members(raw: DataFrame, suffix: str = ".xml") -> DataFrame:
    """(path, content) of the members of zip files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, body in zip(b.column("path").to_pylist(), b.column("content")):
                with zipfile.ZipFile(io.BytesIO(body.as_py())) as z:
                    for name in z.namelist():
                        if name.lower().endswith(suffix):
                            yield pa.RecordBatch.from_pydict({"path": [f"{path}!{name}"], "content": [z.read(name)]}, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return raw.select("path", "content").mapInArrow(run, "path string, content binary")


def accepted_suffix(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in TEXT_SUFFIXES) + ")$")


def edition(catalogue: DataFrame, title: int) -> DataFrame:
    """Current edition date of a title from a catalogue (json string with titles[])."""
    t = F.from_json("json", "titles array<struct<number:int,up_to_date_as_of:string,latest_issue_date:string>>")
    x = catalogue.select(F.explode(t["titles"]).alias("t")).where(F.col("t.number") == title)
    return x.select(F.coalesce("t.up_to_date_as_of", "t.latest_issue_date").alias("edition"))


def refresh_status(landed: DataFrame, force: bool = False) -> DataFrame:
    """Per item of (name, url, age_hours, problem, same): what a conditional refresh does.

    No url: skipped. Younger than the limit: unchanged. A failed or rejected download
    keeps the current copy. Equal bytes are unchanged; the rest is updated.
    """
    young = F.lit(not force) & (F.col("age_hours") < TTL_HOURS)
    s = F.when(F.coalesce(F.col("url"), F.lit("")) == "", "skipped").when(young, "unchanged").when(F.coalesce(F.col("problem"), F.lit("")) != "", "kept").when(F.col("same"), "unchanged").otherwise("updated")
    return landed.withColumn("status", s)


def first_available(fetched: DataFrame, shipped: DataFrame, key: str) -> DataFrame:
    """Fetched rows, and shipped ones where nothing was fetched under their key."""
    return fetched.unionByName(shipped.join(fetched.select(key).distinct(), key, "left_anti"))


def merged_manifest(old: Column, new: Column) -> Column:
    """A manifest (map of strings) with newer fields over older ones; null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)


def reply_text(raw: Column) -> Column:
    """The text of a streamed model reply, given as its raw lines.

    NDJSON lines carry message.content, server-sent events choices[0].delta.content.
    Lines that are no JSON are skipped; nothing counts after the end mark.
    """
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^data:\s*", ""))), lambda x: x != "")
    ended = lambda x: (x == "[DONE]") | F.coalesce(F.get_json_object(x, "$.done") == "true", F.lit(False)) | F.coalesce(F.get_json_object(x, "$.choices[0].finish_reason") != "null", F.lit(False))
    # the line that carries the end mark still counts; the first such line is the last
    last = F.array_position(F.transform(lines, ended), True)
    upto = F.when(last > 0, F.slice(lines, F.lit(1), last.cast("int"))).otherwise(lines)
    text = lambda x: F.coalesce(F.get_json_object(x, "$.message.content"), F.get_json_object(x, "$.choices[0].delta.content"), F.lit(""))
    return F.array_join(F.transform(upto, text), "")
