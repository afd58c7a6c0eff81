"""Verification, conversation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import conversation as C
from corpusmill.operators import evalkit as E
from corpusmill.operators import retrieve as R
from corpusmill.operators import verify as V
from corpusmill.plans.registry import Registry
from corpusmill.plans.staging import table
from corpusmill.streaming import waiting as W

query = Registry()


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) of benchmark items that stand whole in a document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return V.containing(items, d).select(F.col("quote_id").alias("item_id"), F.col("source_id").alias("doc_id"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark, sf_dir)


@query("SELECT item_id, min(doc_id) AS doc_id, count(*) AS sources FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def quote_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark, sf_dir).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("sources"))


_FOLD = r"rtrim(ltrim(lower(trim(regexp_replace({t}, '\s+', ' ', 'g'))), ' .;:'), ' .;:')"
_QSPLIT = r"""list_filter(string_split(regexp_replace(trim(text), '([.;:])\s+([A-Z("''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')"""


@query(f"""WITH p AS (SELECT item_id, unnest({_QSPLIT}) AS s, unnest(range(len({_QSPLIT}))) AS part FROM benchmark),
hit AS (SELECT item_id, part, min(doc_id) AS doc_id FROM p JOIN documents d ON length({_FOLD.format(t='s')}) >= 25 AND contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), {_FOLD.format(t='s')}) GROUP BY ALL)
SELECT item_id, part::INT AS part, coalesce(hit.doc_id, -1) AS source, hit.doc_id IS NOT NULL AS kept FROM p LEFT JOIN hit USING (item_id, part)""")
def quote_sentence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are the slate of all items."""
    points = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("id"), F.col("item_id").alias("point"), F.lit(-1).alias("cited"), F.col("text").alias("quote"), F.lit("").alias("applies"))
    slate = table(spark, sf_dir, "documents").select(F.lit(0).alias("id"), F.col("doc_id").alias("source"), "text")
    return V.check_quotes(points, slate).select(F.col("point").alias("item_id"), "part", F.coalesce("source", F.lit(-1).cast("long")).alias("source"), "kept")


_DEON = T.DEONTIC.replace("'", "''")
_BLOCKS = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '\n(\s*(?:[-*•]|\d+\.))', chr(1) || '\1', 'g'), chr(1)), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '')"""


@query(f"SELECT conv_id, turn, count(*) AS n FROM (SELECT conv_id, turn, unnest({_BLOCKS}) AS b FROM (SELECT conv_id, turn, 'You must file. ' || replace(text, 'the ', 'you may ') AS text FROM conversations WHERE role = 'assistant')) WHERE regexp_matches(b, '{_DEON}') AND NOT regexp_matches(b, '\\[(\\d{{1,2}})\\]') GROUP BY ALL")
def deontic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("You must file. "), F.replace(F.col("text"), F.lit("the "), F.lit("you may ")))
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("id"), t.alias("text"))
    return V.ungrounded(a).select("id.*", "n")


@query(r"""WITH a AS (SELECT conv_id, turn, replace(text, '. ', '? ') AS text FROM conversations),
p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[-1] AS last FROM a)
SELECT conv_id, turn, len(list_filter(list_transform(regexp_extract_all(last, '[^.!?\n]*\?'), lambda q: trim(q)), lambda q: q <> ''))::BIGINT AS n FROM p WHERE len(list_filter(list_transform(regexp_extract_all(last, '[^.!?\n]*\?'), lambda q: trim(q)), lambda q: q <> '')) > 1""")
def closing_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.replace(F.col("text"), F.lit(". "), F.lit("? ")).alias("text"))
    return V.too_many_questions(a).select("id.*", "n")


_BRACKETED = "text || ' [' || doc_id % 15 || '] and [' || doc_id % 4 || '], [' || doc_id % 15 || '] but not [2024]'"


@query(f"SELECT DISTINCT doc_id AS id, n::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_BRACKETED}, '\\[(\\d{{1,2}})\\]', 1))::INT AS n FROM documents) WHERE n < 1 OR n > doc_id % 9")
def uncited_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers that cite three numbers, with 0 to 8 sources each."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_BRACKETED).alias("text"), (F.col("doc_id") % 9).cast("int").alias("n_sources"))
    return V.out_of_range(d)


@query("""WITH a AS (SELECT doc_id, [{'t': '8', 's': '214.' || doc_id % 12, 'r': '8 CFR § 214.' || doc_id % 12 || '(f)'}, {'t': CASE WHEN doc_id % 5 = 0 THEN '20' ELSE '8' END, 's': '274a.' || doc_id % 7, 'r': CASE WHEN doc_id % 5 = 0 THEN '20' ELSE '8' END || ' C.F.R. 274a.' || doc_id % 7}] AS cs FROM documents),
c AS (SELECT doc_id, unnest(cs) AS c FROM a)
SELECT doc_id AS id, c.r AS raw, CASE WHEN c.t <> '8' THEN 'wrong title' ELSE 'in no source' END AS problem FROM c WHERE c.t <> '8' OR NOT (c.s = '214.' || doc_id % 10 OR c.s = '274a.' || doc_id % 3 OR c.s = '214.' || doc_id % 11)""")
def bad_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two citations an answer; its slate cites one section and mentions two."""
    k = lambda n: (F.col("doc_id") % n).cast("string")
    title = F.when(F.col("doc_id") % 5 == 0, "20").otherwise("8")
    d = table(spark, sf_dir, "documents")
    answers = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("See 8 CFR § 214."), k(12), F.lit("(f) and "), title, F.lit(" C.F.R. 274a."), k(7), F.lit(" too.")).alias("text"))
    slate = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("8 CFR § 214."), k(10), F.lit("(a)")).alias("citation"), F.concat(F.lit("As 8 CFR § 274a."), k(3), F.lit("(b) has it, and 8 CFR 214."), k(11), F.lit(" says.")).alias("text"))
    return V.bad_citations(answers, slate)


_STATED = """WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE + 4018 AS d FROM orders),
x AS (SELECT k, d + (k % 6)::INT AS stated, d + 10 AS first_end, d + 3 AS second_end, k % 4 = 0 AS cited_says, k % 5 = 0 AS other_says FROM o)"""


@query(f"""{_STATED} SELECT k AS id, stated AS d,
CASE WHEN stated = second_end THEN 'boundary' WHEN CASE WHEN k % 3 > 0 THEN cited_says ELSE cited_says OR other_says END THEN 'supported' WHEN abs(stated - second_end) BETWEEN 1 AND 3 THEN 'drift' ELSE 'derived' END AS verdict,
CASE WHEN stated <> second_end AND NOT (CASE WHEN k % 3 > 0 THEN cited_says ELSE cited_says OR other_says END) AND abs(stated - second_end) BETWEEN 1 AND 3 THEN second_end END AS boundary FROM x""")
def stated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer an order states one date near a computed boundary; sources say it for some, and some answers cite."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 4018).alias("b"))
    stated = F.date_add("b", (k % 6).cast("int"))
    iso, prose = F.date_format(stated, "yyyy-MM-dd"), F.date_format(stated, "MMMM d, yyyy")
    answers = o.select(k.alias("id"), F.concat(F.lit("You must file by "), iso, F.when(k % 3 > 0, " [1].").otherwise(".")).alias("text"), F.lit("").alias("settled"))
    one = o.select(k.alias("id"), F.lit(1).alias("source"), F.when(k % 4 == 0, F.concat(F.lit("The day is "), prose, F.lit("."))).otherwise("No day here.").alias("served"))
    two = o.select(k.alias("id"), F.lit(2).alias("source"), F.when(k % 5 == 0, F.concat(F.lit("See "), prose)).otherwise("").alias("served"))
    ends = o.select(k.alias("id"), F.lit(0).alias("ord"), F.lit("grace").alias("name"), F.date_add("b", 10).alias("d")).unionByName(o.select(k.alias("id"), F.lit(1).alias("ord"), F.lit("filing").alias("name"), F.date_add("b", 3).alias("d")))
    return V.check_dates(answers, one.unionByName(two), ends).select("id", "d", "verdict", "boundary")


@query("SELECT conv_id, turn, back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user') WHERE back <= 3")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "back")


_NWORDS = r"len(list_filter(string_split_regex({t}, '\s+'), lambda x: x <> ''))"
_NEEDS = "(" + _NWORDS.format(t="text") + " <= 8 OR regexp_matches(lower(trim(text)), '^(" + "|".join(T.OPENERS) + ")'))"


@query(f"SELECT conv_id, turn, CASE WHEN prev IS NOT NULL AND {_NEEDS} THEN prev || ' ' || text ELSE text END AS query FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role = 'user')")
def previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_previous(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "query")


@query(f"SELECT conv_id, turn, {_NEEDS} AS context, {_NWORDS.format(t='text')} > 12 AND regexp_matches(' ' || lower(text) || ' ', '" + "|".join(T.FIRST_PERSON).replace("'", "''") + "') AS situational FROM conversations")
def context_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.needs_context(t).alias("context"), T.situational(t).alias("situational"))


@query("""WITH x AS (SELECT *, coalesce(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM conversations)
SELECT conv_id, max(turn) AS turn, 'user' AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM x WHERE role IN ('user', 'system') GROUP BY conv_id, g
UNION ALL SELECT conv_id, turn, role, text FROM x WHERE role NOT IN ('user', 'system')""")
def fold_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fold_system(table(spark, sf_dir, "conversations"))


@query(f"""WITH r AS (SELECT conv_id, turn, '- ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user'),
w AS (SELECT *, sum({_NWORDS.format(t='line')}) OVER (PARTITION BY conv_id ORDER BY back ROWS UNBOUNDED PRECEDING) AS words FROM r WHERE back <= 3)
SELECT conv_id, count(*) AS kept, string_agg(line, chr(10) ORDER BY turn) AS body FROM w WHERE back = 1 OR floor(words * 1.33::DOUBLE) <= 60 GROUP BY conv_id""")
def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history(table(spark, sf_dir, "conversations"), tokens=60)


@query(f"""WITH c AS (SELECT lang, doc_id, floor({_NWORDS.format(t='text')} * 1.33::DOUBLE)::BIGINT AS cost FROM documents),
r AS (SELECT *, sum(cost) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM c)
SELECT lang, doc_id, used::BIGINT AS used FROM r WHERE n = 1 OR used <= 6000""")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", T.n_tokens(F.col("text")).alias("cost"))
    return C.fits_spread(d, 6000, "lang", "doc_id", F.col("cost")).select("lang", "doc_id", "used")


_CW = "list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP) + ")))"
_SENT = r"list_filter(string_split(regexp_replace(trim({t}), '([.;:])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')"


def _support_sql(claim: str, claims: str) -> str:
    return f"""WITH c AS MATERIALIZED (SELECT {claim} AS claim, {_CW.format(t='text')} AS cw, row_number() OVER () AS k FROM {claims}),
s AS MATERIALIZED (SELECT r, unnest({_CW.format(t='s')}) AS word FROM (SELECT s, row_number() OVER () AS r FROM (SELECT DISTINCT unnest({_SENT.format(t='text')}) AS s FROM documents))), cx AS (SELECT k, unnest(cw) AS word FROM c),
m AS (SELECT k, max(n) AS n FROM (SELECT k, r, count(*) AS n FROM cx JOIN s USING (word) GROUP BY k, r) GROUP BY k)
SELECT claim, round(CASE WHEN len(cw) = 0 THEN 1.0::DOUBLE ELSE coalesce(n, 0)::DOUBLE / len(cw) END, 6) AS ratio, (CASE WHEN len(cw) = 0 THEN 1.0::DOUBLE ELSE coalesce(n, 0)::DOUBLE / len(cw) END) < 0.6 AS flagged FROM c LEFT JOIN m USING (k)"""


def _support(spark: SparkSession, sf_dir: str, claims: DataFrame) -> DataFrame:
    return V.support_in_any(claims, table(spark, sf_dir, "documents").select("text")).select("claim", F.round("ratio", 6).alias("ratio"), "flagged")


@query(_support_sql("item_id", "benchmark"))
def word_overlap_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a claim against the sentences of all documents."""
    return _support(spark, sf_dir, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim"), "text"))


@query(_support_sql("item_id", "benchmark"))
def word_overlap_support_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; the name that earlier callers use."""
    return word_overlap_support(spark, sf_dir)


@query(_support_sql("conv_id || '/' || turn", "conversations"))
def turn_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a claim against the sentences of all documents."""
    return _support(spark, sf_dir, table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("claim"), "text"))


_CHECKS = (("says idiot", r"\bidiot\b", "must_not"), ("ends sentences", r"\.\s", "must"), ("has digits", r"\d", "must"), ("has pipes", r"\|", "must_not"))
_CVALS = ", ".join(f"('{n}', '{p}', '{k}')" for n, p, k in _CHECKS)
_MATRIX = f"m AS (SELECT doc_id, lang, name, kind, regexp_matches(text, '(?is)' || pattern) = (kind = 'must') AS passed FROM documents, (VALUES {_CVALS}) c(name, pattern, kind))"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = spark.createDataFrame(_CHECKS, "name string, pattern string, kind string")
    return E.matrix(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), checks)


@query(f"WITH {_MATRIX} SELECT doc_id, name, passed FROM m")
def check_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).select(F.col("id").alias("doc_id"), "name", "passed")


@query(f"WITH {_MATRIX} SELECT name, kind, sum(passed::INT)::BIGINT AS passes FROM m GROUP BY name, kind")
def check_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tally(_matrix(spark, sf_dir)).select("name", "kind", "passes")


@query(f"WITH {_MATRIX} SELECT lang, name, sum(passed::INT)::BIGINT AS passes, count(*) AS checks FROM m GROUP BY ROLLUP (lang, name)")
def check_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return E.rollup(m, "lang", "name")


@query("SELECT *, tp::DOUBLE / u AS recall, tp::DOUBLE / (tp + fp) AS precision FROM (SELECT sum((label = 'U' AND flagged)::INT)::BIGINT AS tp, sum((label NOT IN ('U', 'N') AND flagged)::INT)::BIGINT AS fp, sum((label = 'U')::INT)::BIGINT AS u, sum((label = 'X')::INT)::BIGINT AS miscited FROM (SELECT CASE WHEN quality = 0 THEN 'U' WHEN toxic = 1 THEN 'X' ELSE 'S' END AS label, n_chars < 1200 AS flagged FROM labels JOIN documents USING (doc_id)))")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    label = F.when(F.col("quality") == 0, "U").when(F.col("toxic") == 1, "X").otherwise("S")
    return E.recall_precision(x.select(label.alias("label"), (F.col("n_chars") < 1200).alias("flagged")))


@query("SELECT lang AS shard, count(*) AS chunks, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY lang")
def shard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("shard")).agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("SELECT coalesce(t.name, 'unknown') AS tier_name, count(*) AS n, round(avg(coalesce(w, 0.8)), 6) AS weight FROM (SELECT regexp_extract(source, '[0-9]+')::INT % 6 AS tier FROM documents) d LEFT JOIN (VALUES (1, 'statute', 1.0::DOUBLE), (2, 'regulation', 0.97), (3, 'policy', 0.92), (4, 'guidance', 0.88), (9, 'personal', 1.0)) t(tier, name, w) USING (tier) GROUP BY 1")
def tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.regexp_extract("source", "[0-9]+", 0).cast("int") % 6).alias("tier"), F.lit(1.0).alias("one"))
    return R.weigh(d, R.tier_table(spark), "one").groupBy("tier_name").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("weight"))


@query("""WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, (l_partkey % 6)::INT AS claim, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE (l_suppkey % 9)::INT END AS source FROM lineitem WHERE l_orderkey % 10 < 8),
f AS (SELECT id, claim, arg_min(coalesce(source, 0), n) AS source FROM l WHERE claim < 4 AND id % 10 > 0 AND NOT (claim = 3 AND id % 3 = 0) GROUP BY id, claim)
SELECT id, claim::BIGINT AS claim, CASE WHEN source BETWEEN 1 AND 5 THEN source END::BIGINT AS source FROM f""")
def json_point_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON reply for every order: its lines as attributions; claims out of range or no integers, sources out
    of range or null, and replies that are cut off, no list or no JSON at all."""
    k = F.col("l_orderkey")
    claim = F.when((F.col("l_partkey") % 6 == 3) & (k % 3 == 0), "true").otherwise((F.col("l_partkey") % 6).cast("string"))
    source = F.when(F.col("l_suppkey") % 4 == 0, "null").otherwise((F.col("l_suppkey") % 9).cast("string"))
    point = F.struct(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("o"), F.concat(F.lit('{"claim": '), claim, F.lit(', "source": '), source, F.lit("}")).alias("p"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["p"]), ", ").alias("ps"))
    whole = F.concat(F.lit('{"attributions": ['), "ps", F.lit("]}"))
    raw = F.when(k % 10 == 0, F.substring(whole, 1, 20)).when(k % 10 == 8, '{"attributions": {}}').when(k % 10 == 9, F.concat(F.lit("I think "), "ps")).otherwise(whole)
    return V.attributions(lines.select(k.alias("id"), raw.alias("raw"), F.lit(4).alias("n_claims"), F.lit(5).alias("n_sources"))).select("id", "claim", "source")


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


#: A turn's words, and what they are as SQL values: about unemployment, days stated, days and STEM extension as replies.
_TURNS = (
    ("How long may I be unemployed?", "true", "NULL", "NULL", "NULL"), ("forty days", "false", "NULL", "'40'", "NULL"), ("yes I am", "false", "NULL", "NULL", "'true'"), ("no", "false", "NULL", "NULL", "'false'"),
    ("I was unemployed for 100 days", "true", "'100'", "'100'", "NULL"), ("thanks", "false", "NULL", "NULL", "NULL"), ("12 and 30 days", "false", "NULL", "'12,30'", "NULL"),
)
_TURN_CASE = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN {t[i]}" for k, t in enumerate(_TURNS)) + " END"


@query(f"""WITH RECURSIVE u AS (SELECT conv_id, turn, (conv_id * 5 + turn * 3) % {len(_TURNS)} AS k, (CASE WHEN conv_id % 10 = 0 THEN turn * 1296000 ELSE turn * 60 END)::BIGINT AS ts FROM conversations WHERE role = 'user'),
t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_TURN_CASE(1)} AS about, {_TURN_CASE(2)} AS stated, {_TURN_CASE(3)} AS as_days, {_TURN_CASE(4)} AS as_stem FROM u),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, NULL::BIGINT AS turn, false AS active, '' AS asked, NULL::VARCHAR AS days, NULL::VARCHAR AS stem, 0::BIGINT AS seen, false AS shown FROM t
UNION ALL SELECT conv_id, n, turn, held AND (days IS NULL OR stem IS NULL), CASE WHEN NOT held THEN '' WHEN days IS NULL THEN 'd' WHEN stem IS NULL THEN 's' ELSE '' END, days, stem, ts, held FROM (
  SELECT conv_id, n, turn, ts, (NOT stale AND active) OR about AS held, coalesce(stated, CASE WHEN NOT stale AND asked = 'd' THEN as_days END, CASE WHEN NOT stale THEN days END) AS days,
         coalesce(CASE WHEN NOT stale AND asked = 's' THEN as_stem END, CASE WHEN NOT stale THEN stem END) AS stem
  FROM (SELECT t.*, r.active, r.asked, r.days, r.stem, t.ts - r.seen > {W.STALE} AS stale FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)))
SELECT conv_id, turn, CASE asked WHEN '' THEN 'outcome' ELSE 'needs' END AS kind, CASE asked WHEN 'd' THEN 'unemployment_days' WHEN 's' THEN 'stem_extension' END AS fact,
CASE WHEN asked = '' THEN CASE WHEN list_sum(list_transform(string_split(days, ','), lambda x: x::DOUBLE)) > CASE stem WHEN 'true' THEN 150 ELSE 90 END THEN 'OVER' ELSE 'REMAIN' END END AS word FROM r WHERE shown""")
def waiting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as one of a few questions and replies; every tenth conversation pauses for weeks between turns."""
    said = F.get(F.array(*[F.lit(t[0]) for t in _TURNS]), ((F.col("conv_id") * 5 + F.col("turn") * 3) % len(_TURNS)).cast("int"))
    ts = F.timestamp_seconds(F.when(F.col("conv_id") % 10 == 0, F.col("turn") * 1296000).otherwise(F.col("turn") * 60))
    x = W.replayed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", said.alias("text"), ts.alias("ts")))
    return x.select("conv_id", "turn", "kind", "fact", F.when(F.col("decision").startswith("OVER"), "OVER").when(F.col("decision").isNotNull(), "REMAIN").alias("word"))
