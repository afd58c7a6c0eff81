"""License scans by ordered signature rules, in DataFrame expressions only.

A text becomes its words (ASCII letters and digits, and whatever is not ASCII; A-Z in lower
case). Texts that hold none of a few stems have no licence and are done. For the others each
rule is gated by its keyword, a literal part of the pattern: only rules whose keyword stands
in the text run their regular expression. They run over words that bear their numbers
(``0:under 1:the 2:mit ..``), so that every match says where it stands.

Detections overlap. One is suppressed if another contains its words and outranks it: by
tier, then by length, then by the rule's place. Sorted by their start, the longest first, a
detection is contained in an outranking one exactly if the farthest end so far of its tier
or a better one reaches its own end. So one fold over a text's detections, with four ends
as its state, decides all of them; ``detections`` gives the survivors as rows, by a window.
Everything happens in a text's own row; nothing is shuffled by ``scan``.

Base phrases are counted in every place where their words stand, and their labels always stay.

Defined results: null and empty texts have no words, no detection and the score 0;
repeated rows and null ids are each scanned; a very long text is scanned whole, in memory
linear in its length; detections of the same words go to the better tier, then to the rule
that comes first; an empty table gives an empty result; other columns, whatever their names,
are not read by ``scan``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.license_rules import CONFIDENCE, RULES, STEMS, Rule
from corpusmill.plans.staging import cut, table

#: phrase, label
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TIERS = range(len(CONFIDENCE))
#: first and end count words; back is -end, so that the longest of one start comes first.
FOUND = "struct<first:int,back:int,tier:int,rule:int,label:string>"


def words(text: Column) -> Column:
    """The words of a text with one space between two."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    # lower() would change other letters, too; it is the faster way where there are none
    low = F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(F.translate(plain, UPPER, UPPER.lower()))
    return F.trim(F.regexp_replace(low, GAP, " "))


def _holds_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def _rule_array(rules: tuple[Rule, ...]) -> Column:
    rows = [{"keyword": r.keyword, "regex": r.regex, "tier": r.tier, "rule": k, "label": r.label} for k, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<keyword:string,regex:string,tier:int,rule:int,label:string>>")


def _places(phrase: str) -> Column:
    """Every word number of ``_cm_a`` at which the phrase stands."""
    ws = phrase.split()
    hit = lambda i: F.array(*[F.get("_cm_a", i + k) for k in range(len(ws))]) == F.array(*[F.lit(w) for w in ws])
    return F.when(F.contains("_cm_n", F.lit(phrase)), F.filter(F.sequence(F.lit(0), F.size("_cm_a") - 1), hit)).otherwise(F.array().cast("array<int>"))


def found(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, stems: tuple[str, ...] = STEMS, base: tuple = BASE) -> DataFrame:
    """``docs`` with n_words, base (places of each base phrase) and found: all detections, sorted.

    The columns _cm_n, _cm_a and _cm_g are the function's own.
    """
    x = docs.withColumn("_cm_n", words(F.col(text)))
    x = x.withColumn("n_words", F.when(F.col("_cm_n") == "", 0).otherwise(F.octet_length("_cm_n") - F.octet_length(F.replace("_cm_n", F.lit(" "), F.lit(""))) + 1).cast("long"))
    x = x.withColumn("_cm_g", _holds_any(F.col("_cm_n"), (*stems, *(p for p, _ in base))))
    x = x.withColumn("_cm_a", F.when(F.col("_cm_g"), F.split("_cm_n", " ")))
    none = F.array().cast("array<array<int>>")
    x = x.withColumn("base", F.when(F.col("_cm_g"), F.array(*[_places(p) for p, _ in base])).otherwise(none))
    numbered = F.concat(F.array_join(F.transform("_cm_a", lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), " "), F.lit(" "))

    def of(r: Column, said: Column) -> Column:
        def one(m: Column) -> Column:
            first = F.substring_index(m, ":", 1).cast("int")
            end = first + F.octet_length(m) - F.octet_length(F.replace(m, F.lit(":"), F.lit("")))
            return F.struct(first.alias("first"), (-end).cast("int").alias("back"), r.tier.alias("tier"), r.rule.alias("rule"), r.label.alias("label"))

        return F.transform(F.regexp_extract_all(said, r.regex, F.lit(0)), one)

    open_rules = F.filter(_rule_array(rules), lambda r: F.contains(F.col("_cm_n"), r.keyword))
    # the numbered words are bound by a lambda, so that they are made once and not for every rule
    hits = F.flatten(F.transform(F.array(numbered), lambda said: F.flatten(F.transform(open_rules, lambda r: of(r, said)))))
    x = x.withColumn("found", F.when(F.col("_cm_g"), F.sort_array(hits)).otherwise(F.array().cast(f"array<{FOUND}>")))
    return x.drop("_cm_n", "_cm_a", "_cm_g")


def _kept_labels() -> Column:
    """labels and score of the detections that no outranking one contains."""
    ends = [f"if(x.tier <= {t}, greatest(a.e{t}, -x.back), a.e{t}) AS e{t}" for t in TIERS]
    inside = "CASE x.tier " + " ".join(f"WHEN {t} THEN a.e{t}" for t in TIERS) + " END >= -x.back"
    trust = "CASE x.tier " + " ".join(f"WHEN {t} THEN {c}D" for t, c in enumerate(CONFIDENCE)) + " END"
    zero = ", ".join(f"0 AS e{t}" for t in TIERS)
    return F.expr(
        f"aggregate(found, struct({zero}, cast(array() AS array<string>) AS labels, 0D AS score),"
        f" (a, x) -> struct({', '.join(ends)}, if({inside} OR array_contains(a.labels, x.label), a.labels, array_append(a.labels, x.label)) AS labels,"
        f" if({inside}, a.score, greatest(a.score, {trust})) AS score), a -> struct(a.labels, a.score))"
    )


def scan(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, stems: tuple[str, ...] = STEMS, base: tuple = BASE) -> DataFrame:
    """The ``carry`` columns of each row, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    inner = docs.select(F.struct(*carry).alias("_cm_row"), F.col(text).alias("_cm_text"))
    x = found(inner, "_cm_text", rules, stems, base).drop("_cm_text").withColumn("kept", F.when(F.size("found") > 0, _kept_labels()))
    places = F.flatten("base")
    named = F.array_compact(F.array(*[F.when(F.size(F.get("base", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(base)]))
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return x.select(
        "_cm_row.*", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(named).alias("base_labels"), joined(F.concat(named, F.coalesce("kept.labels", F.array().cast("array<string>")))).alias("labels"), F.coalesce("kept.score", F.lit(0.0)).alias("score"),
    )


def detections(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, stems: tuple[str, ...] = STEMS) -> DataFrame:
    """The ``carry`` columns, first_word, end_word, label, tier, rule of every detection that stays, a row each."""
    inner = docs.select(F.struct(*carry).alias("_cm_row"), F.col(text).alias("_cm_text"))
    x = found(inner, "_cm_text", rules, stems, ()).where(F.size("found") > 0).select("_cm_row", "found")
    x = cut(x).withColumn("_cm_id", F.monotonically_increasing_id()).select("_cm_row", "_cm_id", F.explode("found").alias("d")).select("_cm_row", "_cm_id", "d.*")
    before = Window.partitionBy("_cm_id").orderBy("first", "back", "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None)
    for t in TIERS:
        reach = F.when(F.col("tier") == t, F.max(F.when(F.col("tier") <= t, -F.col("back"))).over(before)).otherwise(reach)
    x = x.withColumn("reach", reach).where(F.coalesce(F.col("reach") < -F.col("back"), F.lit(True)))
    return x.select("_cm_row.*", F.col("first").cast("long").alias("first_word"), (-F.col("back")).cast("long").alias("end_word"), "label", "tier", "rule")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({k}, {r.tier}, {quoted(r.label)}, {quoted(r.keyword)}, {quoted(r.regex)})" for k, r in enumerate(RULES))
    trust = " ".join(f"WHEN {t} THEN {c}::DOUBLE" for t, c in enumerate(CONFIDENCE))
    hits = []
    for phrase, label in BASE:
        ws = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(ws))
        hits.append(f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: {same})) AS i FROM a WHERE contains(n, '{phrase}')")
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{GAP}', ' ', 'g'), ' ') AS n
  FROM documents
), a AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN n = '' THEN [] ELSE string_split(n, ' ') END AS w FROM d),
rule AS (SELECT * FROM (VALUES {rules}) AS t(rule, tier, label, keyword, regex)),
b AS ({" UNION ALL ".join(hits)}),
g AS MATERIALIZED (
  SELECT r, rule, tier, label, regex, s FROM (
    SELECT r, n, array_to_string(list_transform(w, lambda x, i: (i - 1)::VARCHAR || ':' || x), ' ') || ' ' AS s FROM a
  ) JOIN rule ON contains(n, keyword)
), f AS (
  SELECT r, rule, tier, label, split_part(m, ':', 1)::INTEGER AS s, split_part(m, ':', 1)::INTEGER + len(m) - len(replace(m, ':', '')) AS e
  FROM (SELECT r, rule, tier, label, unnest(regexp_extract_all(s, regex)) AS m FROM g)
), k AS (
  SELECT r, label, CASE tier {trust} END AS trust FROM f AS x
  WHERE NOT EXISTS (SELECT 1 FROM f AS y WHERE y.r = x.r AND y.s <= x.s AND y.e >= x.e
    AND (y.tier < x.tier OR y.tier = x.tier AND (y.e - y.s > x.e - x.s OR y.e - y.s = x.e - x.s AND y.rule < x.rule)))
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bs.n, 0)::BIGINT AS n_base, bs.lo::BIGINT AS first_word, bs.hi::BIGINT AS last_word,
       coalesce(bs.labels, '') AS base_labels, coalesce(ls.labels, '') AS labels, coalesce(ks.score, 0::DOUBLE) AS score
FROM a LEFT JOIN (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY r) AS bs USING (r)
LEFT JOIN (SELECT r, max(trust) AS score FROM k GROUP BY r) AS ks USING (r)
LEFT JOIN (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM k) GROUP BY r) AS ls USING (r)
"""


OP12_SQL = _sql()
