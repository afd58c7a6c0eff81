"""Token counts through a digest cache.

A row of the cache is (content digest, tokenizer digest, n_tokens), stored by tokenizer
and first hexadecimal digit of the content digest. The run's distinct digests, which are
narrow, meet the stored ones by an anti-join; what is left are the distinct misses. Only
texts whose digit has a miss leave the scan, one for each missing digest is encoded, and
the counts are appended. Counts then join back by digest. A cache may be far larger than
a run: it is scanned for the digits and digests that the run has, not grouped whole.

Misses are encoded in waves over the digits. Each wave looks the cache up again and
appends before the next begins, so a run that is lost goes on from the last wave, and
texts of one wave only are on disk at a time.

The content is normalised only in ways that cannot change a count: a null text
is the empty text. The digest is SHA-256 over the UTF-8 bytes. The tokenizer
digest covers the vocabulary file's bytes and the counting options, so another
version of a tokenizer never reads older counts.

Defined results: null and empty texts have 0 bytes and 0 tokens; null ids are
kept; repeated rows each get a row; a very long text is encoded whole; an empty table
gives an empty result; other columns, whatever their names, are not read. Two runs that
append the same digest at a time leave equal rows, of which one counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.process_cache import frugal, kept
from corpusmill.plans.staging import BROADCAST_ROWS, cut, small_batches, small_or_shuffled, splittable, table, work_folder

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string, prefix string"
#: Waves in which the query encodes its misses.
WAVES = 2


def _encoder(path: str, name: str):
    """texts -> counts, by the library that the file's kind belongs to."""
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str = TOKENIZER) -> str:
    with open(_path(name), "rb") as f:
        return hashlib.sha256(b"plain-count-1\0" + f.read()).hexdigest()


def encode(texts: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """digest, n_tokens, tokenizer, prefix for rows (digest, text); bounded batches of texts."""
    version = tokenizer_digest(name)
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _path(name)
        count = kept(("encoder", path), lambda: _encoder(path, name))
        for b in batches:
            column, counts, part, size = b.column("text"), [], [], 0
            for x in column:
                part.append(x.as_py())
                size += len(part[-1])
                if size > 1_000_000 or len(part) >= 256:
                    counts += count(part)
                    part, size = [], 0
            counts += count(part) if part else []
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    found = texts.select("digest", "text").mapInArrow(frugal(run), "digest binary, n_tokens long")
    return found.select("digest", "n_tokens", F.lit(version).alias("tokenizer"), _prefix().alias("prefix"))


def _prefix() -> Column:
    return F.lower(F.substring(F.hex("digest"), 1, 1))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version)


def misses(digests: DataFrame, cache: str, version: str) -> DataFrame:
    """digest, prefix of the distinct ``digests`` that have no stored count."""
    stored = read_cache(digests.sparkSession, cache, version).select("digest", "prefix")
    return digests.select("digest", _prefix().alias("prefix")).join(stored, ["prefix", "digest"], "left_anti").select("digest", "prefix")


def token_counts(docs: DataFrame, cache: str, tokenizer: str = TOKENIZER, limit: int = LIMIT, waves: int = 1) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``cache`` is a folder that driver and executors share; it is made if absent
    and appended to by this call.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    slim = cut(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    digests = cut(slim.where("n_bytes > 0").select("digest").distinct())
    for left in range(waves, 0, -1):
        missing = cut(misses(digests, cache, version))
        found = {r.prefix: r["count"] for r in missing.groupBy("prefix").count().collect()}  # 16 at most
        wave = sorted(found)[: -(-len(found) // left)]
        if not wave:
            break
        texts = rows.where(_prefix().isin(wave)).select("digest", "text").where("text != ''")
        todo = missing.where(F.col("prefix").isin(wave)).select("digest")
        if sum(found[p] for p in wave) <= BROADCAST_ROWS:
            texts = texts.join(F.broadcast(todo), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            texts = texts.dropDuplicates(["digest"]).join(todo, "digest", "left_semi")
        encoded = encode(texts, tokenizer)
        encoded.hint("rebalance", F.col("prefix")).write.mode("append").partitionBy("tokenizer", "prefix").parquet(cache)
    stored = read_cache(spark, cache, version).join(small_or_shuffled(digests), "digest", "left_semi")
    stored = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    n = F.when(F.col("n_bytes") == 0, F.lit(0)).otherwise(F.col("n_tokens")).cast("long")
    return splittable(slim, stored, ["digest"], "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is spark.corpusmill.tokenCache, or a new one in the shared folder that goes with
    the session. The second wave finds stored what the first one appended."""
    cache = spark.conf.get("spark.corpusmill.tokenCache", None) or work_folder(spark, "token-cache")
    return token_counts(table(spark, sf_dir, "documents"), cache, waves=WAVES)
