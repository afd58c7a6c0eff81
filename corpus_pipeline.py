"""The training-data pipeline: rules, near-dedup, decontamination, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage judges all rows that its predecessor
kept, on whole texts.

Defined results, stage by stage. Null and empty texts: fail the rules (few words). Rows
with null ids are judged by their own text in every stage: kept, dropped as copies (a
group without any id keeps one text), dropped as benchmark copies, mixed, packed under a
null id. Repeated rows: equal rows of the id that stands for a group all stay; packing
packs each. One id with several texts: each text is judged alone. Ties: the smallest id
stands for a group; the hash-random keys of the mix differ for all but equal rows. Very
long texts are judged, cut and packed whole. Columns whose names clash with those that an
operator makes pass through all stages but the last untouched. An empty table passes
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontamination, mixing, packing, quality_rules, simhash
from corpusmill.plans.staging import table, work_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), null_ids=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.matrices(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID packing", pack),
]

#: Tokenising and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage keeps is written once as Parquet in the shared folder
    and read from there by the next, which may pass over it several times."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{work_folder(spark, 'pipeline')}/rows")
            docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
