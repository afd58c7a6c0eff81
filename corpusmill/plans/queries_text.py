"""Ingestion and text queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import ingest as G
from corpusmill.operators import packing_text as P
from corpusmill.operators import terminology as X
from corpusmill.plans.numbering import numbered
from corpusmill.plans.registry import Registry
from corpusmill.plans.staging import table, work_folder
from corpusmill.sources import landing as L
from corpusmill.sources import shards

query = Registry()

_WORDS = "len(list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> ''))"


def _strip(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


_SENT = r"list_filter(string_split(regexp_replace(trim(text), '([.;:])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')"


@query(f"SELECT page_id, {_strip('html')} AS text FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(f"SELECT page_id, 1::BIGINT AS ord, 1 AS level, {_strip(chr(39) + chr(39) + ' || regexp_extract(html, ' + chr(39) + '(?is)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1)')} AS title FROM pages WHERE regexp_matches(html, '(?i)<h1')")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.headed(table(spark, sf_dir, "pages")).where("level > 0").select(F.col("id").alias("page_id"), "ord", "level", "title")


@query(f"SELECT doc_id, {_WORDS.format(t='text')}::BIGINT AS words, floor({_WORDS.format(t='text')} * 1.33::DOUBLE)::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.n_words(F.col("text")).alias("words"), T.n_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, unnest({_SENT}) AS sentence FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


_TOK = "floor({w} * 1.33::DOUBLE)::BIGINT".format(w=_WORDS.format(t="{t}"))
_PACK = f"""WITH d AS (SELECT doc_id, list_transform({_SENT}, lambda s: {{'t': s, 'c': {_TOK.format(t='s')}}}) AS ps FROM documents),
f AS (SELECT doc_id, list_reduce(ps, lambda s, x:
  CASE WHEN x.c > 1.6 * 330 THEN {{'held': []::STRUCT(t VARCHAR, c BIGINT)[], 'out': s.out || (CASE WHEN len(s.held) > 0 THEN [list_transform(s.held, lambda h: h.t)] ELSE []::VARCHAR[][] END) || [[x.t]]}}
       WHEN len(s.held) > 0 AND coalesce(list_sum(list_transform(s.held, lambda h: h.c)), 0) + x.c > 330 THEN
         {{'held': s.held[coalesce(list_max(list_filter(range(1, len(s.held) + 1), lambda k: list_sum(list_transform(s.held[k:], lambda h: h.c)) >= 80)), 1):] || [x], 'out': s.out || [list_transform(s.held, lambda h: h.t)]}}
       ELSE {{'held': s.held || [x], 'out': s.out}} END,
  {{'held': []::STRUCT(t VARCHAR, c BIGINT)[], 'out': []::VARCHAR[][]}}) AS s FROM d),
p AS (SELECT doc_id, list_filter(list_transform(s.out || (CASE WHEN len(s.held) > 0 THEN [list_transform(s.held, lambda h: h.t)] ELSE []::VARCHAR[][] END), lambda g: array_to_string(g, ' ')), lambda t: regexp_matches(t, '\\S')) AS ts FROM f),
u AS (SELECT doc_id, unnest(range(len(ts)))::INT AS piece, unnest(ts) AS text FROM p)
SELECT doc_id, piece, {_TOK.format(t='text')} AS tokens, text, '' AS embed_text FROM u"""


@query(_PACK)
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as paragraphs; no document of the test tables enumerates (see enumerated_split)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("paragraphs"))
    return P.packed(d, budget=330).select(F.col("id").alias("doc_id"), "piece", T.n_tokens(F.col("text")).alias("tokens"), "text", "embed_text")


_NUMERALS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")  # after the tenth sentence they start anew
_SPLIT = f"""WITH d AS (SELECT doc_id, '8 CFR § 9.' || doc_id AS line, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS body, {_SENT} AS ss FROM documents),
e AS (SELECT *, list_transform(ss, lambda x, i: '(' || ['{"', '".join(_NUMERALS)}'][(i - 1) % 10 + 1] || ') Item ' || x) AS items, rtrim(line || chr(10) || array_to_string(body, ' '), chr(10)) AS stem FROM d),
g AS (SELECT *, line || chr(10) || array_to_string(body, ' ') || ' ' || array_to_string(items, ' ') AS whole FROM e),
h AS (SELECT *, len(items) >= 4 AND {_TOK.format(t='whole')} >= 400 AS apart, trim(line || ' ' || array_to_string(body[greatest(len(body) - 119, 1):], ' ')) AS lead FROM g),
u AS (SELECT doc_id, CASE WHEN apart THEN [{{'t': stem, 'e': ''}}] || list_transform(items, lambda i: {{'t': lead || ' ' || regexp_replace(i, '^\\s+|\\s+$', '', 'g'), 'e': regexp_replace(i, '^\\s+|\\s+$', '', 'g')}}) ELSE [{{'t': whole, 'e': ''}}] END AS ps FROM h)
SELECT doc_id, piece, p.t AS text, p.e AS embed_text FROM (SELECT doc_id, unnest(range(len(ps)))::INT AS piece, unnest(ps) AS p FROM u)"""


@query(_SPLIT)
def enumerated_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a provision: a citing line, its words, and its sentences as items."""
    numeral = F.array(*map(F.lit, _NUMERALS))
    items = F.transform(T.sentences(F.col("text")), lambda x, i: F.concat(F.lit("("), F.get(numeral, i % 10), F.lit(") Item "), x))
    whole = F.concat(F.lit("8 CFR § 9."), F.col("doc_id").cast("string"), F.lit("\n"), F.array_join(T.words(F.col("text")), " "), F.lit(" "), F.array_join(items, " "))
    p = P.packed(table(spark, sf_dir, "documents").select("doc_id", F.array(whole).alias("paragraphs")), budget=10**9)
    return p.select(F.col("id").alias("doc_id"), "piece", "text", "embed_text")


@query("SELECT 'd' || lang || ':' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS id, doc_id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug:n in emit order of each shard, numbered over ranges of keys."""
    n = numbered(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["doc_id"], ["lang"])
    return n.select(F.concat(F.lit("d"), "lang", F.lit(":"), F.col("n").cast("string")).alias("id"), "doc_id")


@query(f"SELECT doc_id, {_WORDS.format(t='text')} >= 12 AS section_ok, {_WORDS.format(t='text')} >= 25 AS page_ok, {_WORDS.format(t='text')} >= 30 AS statute_ok, {_WORDS.format(t='text')} >= 40 AS chapter_ok FROM documents")
def min_content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.n_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[(n >= k).alias(c) for c, k in (("section_ok", G.MIN_SECTION), ("page_ok", G.MIN_PAGE), ("statute_ok", G.MIN_STATUTE), ("chapter_ok", G.MIN_CHAPTER))])


@query("SELECT min(doc_id) AS doc_id, source, text[1:80] AS head, count(*) AS copies FROM documents GROUP BY source, text[1:80]")
def exact_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrence by citation and the first 80 characters, with partial aggregation."""
    return table(spark, sf_dir, "documents").groupBy("source", F.substring("text", 1, 80).alias("head")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, text")
def first_seen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of every source and whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return G.first_seen(d, [F.col("source"), F.col("digest")], "doc_id").select("doc_id", "source")


@query("SELECT lang AS shard, count(*) AS chunks, date_diff('day', DATE '2026-01-01' + (ascii(lang) % 7)::INTEGER * 10, DATE '2026-03-01')::INT AS age_days, date_diff('day', DATE '2026-01-01' + (ascii(lang) % 7)::INTEGER * 10, DATE '2026-03-01') > 30 AS stale FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def shard_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as shards, fetched on days that follow from their names."""
    p = table(spark, sf_dir, "documents").select(F.col("lang").alias("shard"))
    fetched = F.date_add(F.lit("2026-01-01").cast("date"), (F.ascii("shard") % 7 * 10).cast("int"))
    m = p.where("shard is not null").distinct().select("shard", fetched.alias("fetched"), F.lit(30).alias("refresh_days"))
    return shards.summary(p, m, "2026-03-01")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents")
def sha256_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return L.manifest(d).select(F.col("name").cast("long").alias("doc_id"), "sha256", "bytes")


@query("SELECT 'd:' || doc_id AS id, lang AS shard, CASE lang WHEN 'de' THEN 9 ELSE 2 END AS tier, source AS citation, length(text)::BIGINT AS chars FROM documents")
def concat_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as shards under a public and a private root, and all read back as one table."""
    d, root = table(spark, sf_dir, "documents"), work_folder(spark, "shards")
    tier, private = F.when(F.col("lang") == "de", 9).otherwise(2), F.coalesce(F.col("lang") == "de", F.lit(False))
    named = {"id": F.concat(F.lit("d:"), F.col("doc_id").cast("string")), "text": F.col("text"), "citation": F.col("source"), "shard": F.col("lang"), "tier": tier}
    p = d.select(*[named.get(c, F.lit("")).alias(c) for c in G.COLUMNS], private.alias("private"))
    for name, own in (("public", ~F.col("private")), ("private", F.col("private"))):
        shards.write(p.where(own), f"{root}/{name}")
    both, rejects = shards.read_all(spark, [f"{root}/public", f"{root}/private", f"{root}/none"])
    assert any(r.startswith(f"{root}/none:") for r in rejects)  # the root that is not there is reported
    both = p.where("false") if both is None else both  # roots without any shard
    return both.select("id", F.col("shard").cast("string").alias("shard"), "tier", "citation", F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, lower(trim(split_part(text, ' ', 1))) AS word, trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:90] AS fingerprint, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS dense FROM documents")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim(F.split_part(t, F.lit(" "), F.lit(1)))).alias("word"), T.fingerprint(t).alias("fingerprint"), F.length(T.squash(t)).cast("long").alias("dense"))


_CITED = """CASE doc_id % 7 WHEN 0 THEN '8 CFR § 214.' || doc_id % 30 WHEN 1 THEN '8 CFR § ' || (200 + doc_id % 90) || 'a.12' WHEN 2 THEN '8 U.S.C. § ' || (1100 + doc_id % 300) || 'a'
WHEN 3 THEN '8 U.S.C. § 1440–' || doc_id % 9 WHEN 4 THEN 'USCIS PM Vol ' || doc_id % 9 || ', Pt F, Ch ' || doc_id % 20 WHEN 5 THEN 'USCIS PM Vol 2, Pt M, Ch ' || doc_id % 20 ELSE 'notes' || doc_id || '.md, p. 4' END"""
_TAILS = "CASE doc_id % 7 WHEN 0 THEN '(f)(5)' WHEN 1 THEN '(c)' WHEN 3 THEN '(b)' WHEN 4 THEN ', D.3' ELSE '' END"


@query(f"SELECT doc_id, {_CITED} || {_TAILS} AS citation, {_CITED} AS section FROM documents")
def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every form, one a document; the section is what was there before the tail."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"{_CITED} || {_TAILS}").alias("citation"))
    return d.select("doc_id", "citation", T.section_key(F.col("citation")).alias("section"))


_QUERIES = ["Can I do CPT before OPT?", "my EB-1A and EB 1 case, CPT (curricular practical training)", "is opt for me", "What is D/S on my I94 or EADs", "F-1 fixed period", "EB-1A or O-1A evidence", "an O-1 person asking", "M1 student asking", "EB1C, EB 2 and NIW; RFE, NOID", "SEVIS, SEVP and my PDSO or DSO about STEM", "EB-1B evidence", "nothing at all"]


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _asked(spark: SparkSession, sf_dir: str, phrases: list[str]) -> DataFrame:
    """Every turn of every conversation with one of the phrases after it."""
    phrase = F.get(F.array(*map(F.lit, phrases)), ((F.col("conv_id") * 3 + F.col("turn")) % len(phrases)).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), phrase).alias("q"))


def _asked_sql(phrases: list[str]) -> str:
    return f"SELECT conv_id, turn, text || ' ' || {_sql_list(phrases)}[(conv_id * 3 + turn) % {len(phrases)} + 1] AS q FROM conversations"


def _expansion_sql() -> str:
    """One step a term; RE2 has no look-around, so what follows a term is kept as a group."""
    steps = [f"WITH s0 AS ({_asked_sql(_QUERIES)})"]
    for n, (_, pattern, words, case) in enumerate(X.TERMS):
        core, after = pattern.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])"), ""
        for ahead in ("[A-Za-z0-9]", "[A-Za-z]"):
            if core.endswith(f"(?!{ahead})"):
                core, after = core.removesuffix(f"(?!{ahead})"), f"($|[^{ahead[1:-1]}])"
        low = words.lower().replace("'", "''")
        steps.append(f"s{n + 1} AS (SELECT conv_id, turn, CASE WHEN contains(lower(q), '{low}') THEN q ELSE regexp_replace(q, '({core}){after}', '\\1 ({words}){chr(92) + '2' if after else ''}', '{'c' if case else 'i'}') END AS q FROM s{n})")
    named = {s: f"regexp_matches(o.q, '(?i){rx}')" for s, rx, _, _ in X.SCOPES}
    sets = []
    for s, _, group, prefixes in X.SCOPES:
        others = " OR ".join(named[o] for o, _, g, _ in X.SCOPES if g == group and o != s)
        sets.append(f"CASE WHEN ({others}) AND NOT {named[s]} THEN {_sql_list(list(prefixes))} ELSE []::VARCHAR[] END")
    return ", ".join(steps) + f" SELECT o.conv_id, o.turn, o.q, x.q AS expanded, array_to_string({' || '.join(sets)}, '|') AS excluded FROM s0 o JOIN s{len(X.TERMS)} x USING (conv_id, turn)"


@query(_expansion_sql())
def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return _asked(spark, sf_dir, _QUERIES).select("conv_id", "turn", "q", X.expand(q).alias("expanded"), F.array_join(X.excluded(q), "|").alias("excluded"))


_FOLLOW = [*_QUERIES, "ok", "Is my priority date current for EB-2 in the visa bulletin?", "What about the time that the agency needs to answer a petition filed in March of that year by mail", "I have a question about the backlog and how my own priority date moves in the coming months"]


@query(f"SELECT conv_id, turn, q, {_WORDS.format(t='q')} <= 8 OR regexp_matches(lower(trim(q)), '^(" + "|".join(T.OPENERS) + ")') AS context, regexp_matches(lower(q), '" + "|".join(T.VOLATILE) + f"') AS volatile, {_WORDS.format(t='q')} > 12 AND regexp_matches(' ' || lower(q) || ' ', '" + "|".join(T.FIRST_PERSON).replace("'", "''") + f"') AS situational FROM ({_asked_sql(_FOLLOW)})")
def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return _asked(spark, sf_dir, _FOLLOW).select("conv_id", "turn", "q", T.needs_context(q).alias("context"), T.needs_bulletin(q).alias("volatile"), T.situational(q).alias("situational"))
