"""Scoring of answers: regex checks, tallies with subtotals, recall and precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """Every answer (id, text) against every check (name, pattern, kind), case-insensitive
    and over lines. The checks are a stated list of a few dozen rows."""
    x = answers.join(F.broadcast(checks))
    found = F.rlike("text", F.concat(F.lit("(?is)"), F.col("pattern")))
    return x.select("id", "name", "kind", F.when(F.col("kind") == "must", found).otherwise(~found).alias("passed"))


def tally(results: DataFrame, repeat: int = 1) -> DataFrame:
    """Passes of each check, and whether most repeats pass (half rounds to even)."""
    return results.groupBy("name", "kind").agg(F.sum(F.col("passed").cast("long")).alias("passes"), F.bround(F.sum(F.col("passed").cast("double")) / repeat).cast("long").alias("score"))


def rollup(results: DataFrame, *by: str) -> DataFrame:
    """Passes and checks for each level, with subtotals and the grand total."""
    return results.rollup(*by).agg(F.sum(F.col("passed").cast("long")).alias("passes"), F.count("*").alias("checks"))


def recall_precision(rows: DataFrame) -> DataFrame:
    """One row from (label, flagged): label U is unsupported, X miscited, N no claim."""
    pos = F.col("label") == "U"
    agg = rows.agg(F.sum((F.col("flagged") & pos).cast("long")).alias("tp"), F.sum((F.col("flagged") & ~pos & (F.col("label") != "N")).cast("long")).alias("fp"), F.sum(pos.cast("long")).alias("u"), F.sum((F.col("label") == "X").cast("long")).alias("miscited"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return agg.select("*", ratio(F.col("tp"), F.col("u")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def labelled(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Claims (slug, ord, ...) with their letters from (slug, letters "S U M ..")."""
    x = labels.select("slug", F.posexplode(F.split(F.trim("letters"), r"\s+")).alias("ord", "label"))
    return claims.join(x, ["slug", "ord"])


def label_mismatches(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Slugs whose claims and letters differ in number: a strict zip refuses them."""
    n = claims.groupBy("slug").agg(F.count("*").alias("claims"))
    return n.join(labels.select("slug", F.size(F.split(F.trim("letters"), r"\s+")).alias("letters")), "slug", "full_outer").where("not (claims <=> letters)")


def read_slates(spark: SparkSession, path: str) -> DataFrame:
    """(slug, question, source, citation, text) from slate files {question, sources: [[citation, text]]}."""
    raw = spark.read.schema("question string, sources array<array<string>>, tail string").option("multiLine", True).json(path)
    x = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("slug"), "question", F.posexplode("sources").alias("source", "s"))
    return x.select("slug", "question", (F.col("source") + 1).alias("source"), F.get("s", 0).alias("citation"), F.get("s", 1).alias("text"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(slug, letters) from one object of slug -> letters."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("slug", "letters"))


def save_answers(answers: DataFrame, path: str) -> None:
    answers.write.mode("overwrite").json(path)
