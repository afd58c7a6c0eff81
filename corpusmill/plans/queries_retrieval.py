"""Index and retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.vectors import norm, unit
from corpusmill.operators import index as I
from corpusmill.operators import retrieve as R
from corpusmill.operators import store
from corpusmill.plans.registry import Registry
from corpusmill.plans.staging import cut, small_or_shuffled, table, work_folder

query = Registry()

QUESTION = "ouing worthless erly the Thonre edshed hethwh onand"
K = 12
_STOP = ", ".join(f"'{w}'" for w in T.STOP)


def tok(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({t}, '{T.TOKEN}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP}))"


_DOCS = f"d AS (SELECT doc_id AS id, {tok('text')} AS tk FROM documents), len AS (SELECT id, greatest(len(tk), 1) AS len FROM d), st AS (SELECT greatest(count(*), 1) AS n, avg(len) AS avglen FROM len), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tk) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"


def bm25_sql(queries: str) -> str:
    """CTEs ending in bm(q, id, bm25) for a relation of (q, text)."""
    return f"""{_DOCS}, qs AS ({queries}), qt AS (SELECT DISTINCT q, term FROM (SELECT q, unnest({tok('text')}) AS term FROM qs)),
bm AS (SELECT q, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avglen))) AS bm25
       FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN len USING (id), st GROUP BY q, id)"""


_Q0 = f"SELECT 0::BIGINT AS q, '{QUESTION}' AS text"
_LEX = f"lex AS (SELECT * FROM (SELECT q, id, bm25, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, id) AS rank FROM bm) WHERE rank <= {R.pool_size(K)})"
_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_DEN = f"""cos AS (SELECT 0::BIGINT AS q, a.vec_id AS id, {_COS} AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 9) DESC, id) AS rank FROM cos) WHERE rank <= {R.pool_size(K)})"""
_FUSED = "fu AS (SELECT q, id, sum(1.0::DOUBLE / (60 + rank)) AS fused FROM (SELECT q, id, rank FROM den UNION ALL SELECT q, id, rank FROM lex) GROUP BY q, id)"
_META = "m AS (SELECT doc_id AS id, source AS citation, 's' || (regexp_extract(source, '[0-9]+')::INT // 5) AS section, lang AS shard, CASE regexp_extract(source, '[0-9]+')::INT % 6 WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.97::DOUBLE WHEN 3 THEN 0.92::DOUBLE WHEN 4 THEN 0.88::DOUBLE ELSE 0.8::DOUBLE END AS weight FROM documents)"


def _question(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, QUESTION)], "q long, text string")


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(I.bm25(table(spark, sf_dir, "documents"), _question(spark)), "bm25", R.pool_size(K))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.dense_top_blocks(e, e.where("vec_id = 0"), R.pool_size(K), _length(e))


def _length(e: DataFrame) -> int:
    """Of the first vector; 1 where there is none."""
    first = e.where("embedding IS NOT NULL").select(F.size("embedding")).first()
    return first[0] if first else 1


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages: citation = source, section = five sources, shard = language."""
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("citation"), F.concat(F.lit("s"), F.floor(n / 5).cast("string")).alias("section"), F.col("lang").alias("shard"), (n % 6).cast("int").alias("tier"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused and weighted rows with metadata; texts stay behind until after ranking."""
    fused = R.fuse(dense(spark, sf_dir), lexical(spark, sf_dir))
    return R.weigh(passages(spark, sf_dir).join(F.broadcast(fused), "id"), R.tier_table(spark))  # two pools at most


@query(f"WITH d AS (SELECT doc_id, {tok('text')} AS tk FROM documents) SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM d) GROUP BY ALL")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(table(spark, sf_dir, "documents")).postings.select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"WITH {_DOCS} SELECT term, df FROM df")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(table(spark, sf_dir, "documents")).term_stats


@query(f"WITH {_DOCS} SELECT n::BIGINT AS n, round(avglen, 6) AS avglen FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(table(spark, sf_dir, "documents")).corpus_stats.select("n", F.round("avglen", 6).alias("avglen"))


@query(f"WITH {_DOCS} SELECT id AS doc_id, len::BIGINT AS len FROM len")
def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(table(spark, sf_dir, "documents")).doc_stats.select(F.col("id").alias("doc_id"), "len")


@query(f"WITH {bm25_sql(_Q0)}, {_LEX} SELECT id AS doc_id, round(bm25, 6) AS bm25, rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"), "rank")


@query(f"WITH {bm25_sql('SELECT item_id AS q, text FROM benchmark')} SELECT q, id AS doc_id, round(bm25, 6) AS bm25, rank FROM (SELECT q, id, bm25, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm) WHERE rank <= 12")
def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    scores = I.bm25_best(table(spark, sf_dir, "documents"), queries, K)
    return R.top(scores, "by", K).select("q", F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"), "rank")


@query(f"WITH {bm25_sql('SELECT item_id AS q, text FROM benchmark')} SELECT q, id AS doc_id, round(bm25, 6) AS bm25, rank FROM (SELECT q, id, bm25, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm) WHERE rank <= 12")
def bm25_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from an index that was written down first."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    index = I.stored(table(spark, sf_dir, "documents"), work_folder(spark, "index"))
    scores = I.bm25_best_indexed(index, queries, K)
    return R.top(scores, "by", K).select("q", F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"), "rank")


@query(f"WITH {bm25_sql('SELECT item_id AS q, text FROM benchmark')} SELECT q, id AS doc_id, round(bm25, 6) AS bm25, rank FROM (SELECT q, id, bm25, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm) WHERE rank <= 12")
def bm25_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from the session's store, where blocks that cannot hold a result are left out."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    return store.kept(table(spark, sf_dir, "documents")).search(queries, K).select("q", F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"), "rank")


_REFRESHED = bm25_sql("SELECT item_id AS q, text FROM benchmark").replace("FROM documents)", "FROM documents WHERE doc_id % 7 <> 0)", 1)


@query(f"WITH {_REFRESHED} SELECT q, id AS doc_id, round(bm25, 6) AS bm25, rank FROM (SELECT q, id, bm25, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm) WHERE rank <= 12")
def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that grew: documents come in two parts, those of one source in an older form, which
    is replaced; every seventh document is taken out. It searches as one built of what is left."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    s = store.Store(spark, work_folder(spark, "store"))
    s.add(d.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("source") == "src0", F.reverse("text")).otherwise(F.col("text"))))
    s.add(d.where("doc_id % 2 = 1"))
    s.add(d.where("source = 'src0'"))
    s.remove(d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id")))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    return s.search(queries, K).select("q", F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"), "rank")


_ALL_COS = f"c AS (SELECT b.vec_id AS q, a.vec_id AS id, a.label, {_COS} AS cosine FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) b)"


def _searches(spark: SparkSession, sf_dir: str, n: int, group: str | None = None) -> DataFrame:
    """The n best of all vectors (of each group) for each vector whose id 20 divides."""
    e = table(spark, sf_dir, "embeddings")
    return R.dense_top_blocks(e, e.where("vec_id % 20 = 0"), n, _length(e), group=group)


@query(f"WITH {_ALL_COS} SELECT q, id AS vec_id, round(cosine, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 9) DESC, id) AS rank FROM c) WHERE rank <= {R.pool_size(K)}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searches(spark, sf_dir, R.pool_size(K)).select("q", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"), "rank")


@query(f"WITH {_ALL_COS} SELECT q, label, id AS vec_id, round(cosine, 6) AS cosine, rank, round(best, 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY round(cosine, 9) DESC, id) AS rank, max(cosine) OVER (PARTITION BY q, label) AS best FROM c) WHERE rank <= 5")
def dense_topk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _searches(spark, sf_dir, 5, "label")
    best = F.max("cosine").over(Window.partitionBy("q", "label"))  # five rows a query and label
    return found.select("q", "label", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"), "rank", F.round(best, 6).alias("best"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-9), 6) AS first FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(e), 6).alias("norm"), F.round(F.get(unit(e), 0), 6).alias("first"))


@query(f"WITH {bm25_sql(_Q0)}, {_LEX}, {_DEN}, {_FUSED} SELECT id AS doc_id, round(fused, 9) AS fused FROM fu")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(dense(spark, sf_dir), lexical(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.round("fused", 9).alias("fused"))


_RANKED = f"WITH {bm25_sql(_Q0)}, {_LEX}, {_DEN}, {_FUSED}, {_META}, r AS (SELECT q, id, citation, section, shard, round(fused * weight, 9) AS score FROM fu JOIN m USING (id))"


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


@query(_RANKED + " SELECT id AS doc_id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r")
def tier_weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _round(ranked(spark, sf_dir))
    return R.top(r, "score", 2 * R.pool_size(K)).select(F.col("id").alias("doc_id"), "score", "rank")


@query(_RANKED + " SELECT id AS doc_id, score FROM r WHERE shard = 'en'")
def post_pool_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard filter acts after both pools were cut, so it never refills them."""
    return R.in_shards(_round(ranked(spark, sf_dir)), ["en"]).select(F.col("id").alias("doc_id"), "score")


@query("SELECT doc_id, citation FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN source || ', B.1' ELSE source || '(a)' END AS citation FROM documents) WHERE NOT (citation = 'src1' OR starts_with(citation, 'src1,') OR starts_with(citation, 'src1(') OR starts_with(citation, 'src1.'))")
def exclude_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cite = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(", B.1"))).otherwise(F.concat("source", F.lit("(a)")))
    return R.without_siblings(d.select("doc_id", cite.alias("citation")), ["src1"])


_CAP3 = "c3 AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY q, citation ORDER BY score DESC, id) AS n FROM r) WHERE n <= 3)"
_CAP4 = "c4 AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY q, section ORDER BY score DESC, id) AS n FROM c3) WHERE n <= 4)"


@query(f"{_RANKED}, {_CAP3} SELECT id AS doc_id, citation, score FROM c3")
def citation_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cap(_round(ranked(spark, sf_dir)), 3, "citation").select(F.col("id").alias("doc_id"), "citation", "score")


@query(f"{_RANKED}, c4 AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY q, section ORDER BY score DESC, id) AS n FROM r) WHERE n <= 4) SELECT id AS doc_id, section, score FROM c4")
def section_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cap(_round(ranked(spark, sf_dir)), 4, "section").select(F.col("id").alias("doc_id"), "section", "score")


@query(f"{_RANKED}, {_CAP3}, {_CAP4} SELECT id AS doc_id, citation, section, score FROM c4")
def double_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.double_cap(_round(ranked(spark, sf_dir))).select(F.col("id").alias("doc_id"), "citation", "section", "score")


def slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped rows with toxic documents as suspended ones, cut at K usable."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(False).alias("ok")).distinct()
    r = R.double_cap(_round(ranked(spark, sf_dir))).join(bad, "id", "left").withColumn("usable", F.coalesce("ok", F.lit(True)))
    return R.cut_usable(r, K)


@query(f"{_RANKED}, {_CAP3}, {_CAP4}, u AS (SELECT c4.*, id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AS usable FROM c4) SELECT id AS doc_id, score, usable, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, coalesce(sum(usable::INT) OVER (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u) WHERE before < 12")
def usable_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slate(spark, sf_dir).select(F.col("id").alias("doc_id"), "score", "usable", "rank")


@query(f"WITH {_ALL_COS} SELECT q, round(max(cosine), 6) AS best, max(cosine) >= 0.62 AS passes FROM c WHERE q <> id GROUP BY q")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _searches(spark, sf_dir, 2).where("q != id")
    return R.gate(found).select("q", F.round("best", 6).alias("best"), "passes")


_TAKE = (
    "CASE WHEN s.usable >= 12 OR list_contains(s.seen, x.name) OR len(list_filter(s.cites, lambda c: c = x.citation)) >= {cap} OR len(list_filter(s.sections, lambda c: c = x.section)) >= 4{more} THEN s "
    "ELSE {{'usable': s.usable + x.usable::INT, 'seen': s.seen || [x.name], 'cites': s.cites || [x.citation], 'sections': s.sections || [x.section], 'out': s.out || [{{'qi': x.qi, 'id': x.id}}]}} END"
)
_NEW = "{'usable': 0, 'seen': []::VARCHAR[], 'cites': []::VARCHAR[], 'sections': []::VARCHAR[], 'out': []::STRUCT(qi INT, id BIGINT)[]}"


@query(f"""WITH {bm25_sql("SELECT item_id AS q, text FROM benchmark")},
r AS (SELECT * FROM (SELECT q, id, round(bm25, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm) WHERE rank <= {K}),
c AS (SELECT r.q // 4 AS question_id, (r.q % 4)::INT AS qi, r.rank, r.id, r.score, source AS citation, source AS section, source || '|' || left(text, 80) AS name, r.id % 5 <> 0 AS usable FROM r JOIN documents ON doc_id = r.id),
l AS (SELECT question_id, list({{'qi': qi, 'id': id, 'citation': citation, 'section': section, 'name': name, 'usable': usable}} ORDER BY qi, rank, id) AS by_query, list({{'qi': qi, 'id': id, 'citation': citation, 'section': section, 'name': name, 'usable': usable}} ORDER BY rank, qi, id) AS by_rank FROM c GROUP BY question_id),
a AS (SELECT *, list_reduce(list_filter(by_query, lambda x: x.qi = 0), lambda s, x: {_TAKE.format(cap=3, more=" OR s.usable >= 6")}, {_NEW}) AS s1 FROM l),
b AS (SELECT *, list_reduce(by_rank, lambda s, x: {_TAKE.format(cap=3, more="")}, s1) AS s2 FROM a),
m AS (SELECT question_id, list_reduce(by_query, lambda s, x: {_TAKE.format(cap=12, more="")}, s2).out AS out FROM b),
f AS (SELECT question_id, unnest(out) AS o, unnest(range(1, len(out) + 1)) AS rank FROM m)
SELECT f.question_id, f.rank, f.o.qi AS qi, f.o.id AS id, c.citation, round(c.score, 6) AS score, c.usable FROM f JOIN c ON c.question_id = f.question_id AND c.qi = f.o.qi AND c.id = f.o.id""")
def slate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in groups of four as one question and its three issues; every fifth document is suspended."""
    d = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    scores = R.top(I.bm25_best(d, queries, K).withColumnRenamed("by", "score"), "score", K)
    rows = cut(scores.select(F.floor(F.col("q") / 4).alias("question_id"), (F.col("q") % 4).alias("qi"), "rank", "id", "score"))
    ids = small_or_shuffled(rows.select("id").distinct())  # texts leave the scan for ranked documents only
    near = d.select(F.col("doc_id").alias("id"), F.col("source").alias("citation"), F.substring("text", 1, 80).alias("text")).join(ids, "id")
    merged = R.merge_slates(rows.join(near, "id").withColumn("usable", F.col("id") % 5 != 0), K)
    return merged.withColumn("score", F.round("score", 6))


@query("SELECT s.shard, s.embed_model, (s.embed_model IS NULL OR s.embed_model IN ('', 'm1')) AS usable FROM (SELECT lang AS shard, CASE lang WHEN 'en' THEN 'm1' WHEN 'fr' THEN '' WHEN 'de' THEN 'm2' END AS embed_model FROM documents GROUP BY lang) s")
def model_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("shard")).agg(F.first(F.expr("case lang when 'en' then 'm1' when 'fr' then '' when 'de' then 'm2' end")).alias("embed_model"))
    return R.compatible(m, "m1").select("shard", "embed_model", "usable")
