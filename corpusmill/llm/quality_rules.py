"""Rule bitmask ledger: measure once, store failure bits, apply policies by bit tests.

Everything here is DataFrame/SQL expressions; no Python runs on executors.

Each rule has one bit. ``ledger`` evaluates all rules once for each row and keeps
the measurements next to ``fail_bits``; ``store`` writes it down without texts. A policy
is a mask: a row passes it if ``fail_bits & mask = 0``. Policies are rows of a table of
versions, so that a new version is a new mask over the stored ledger and never a new
pass over the texts. ``ablation`` reads only the counts of distinct ``fail_bits``.

Defined results: a null text counts as empty (all counts 0, rule 0 fails); null
ids are kept; repeated rows are each judged; a very long text is measured whole, in
memory linear in its length; a line or window that ties with an earlier one repeats it,
and windows count with their first occurrence; an empty table gives an empty ledger;
other columns of the input, whatever their names, pass through ``ledger`` untouched
unless they bear the name of a ledger column, in which case the ledger's replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.staging import table, work_folder

#: Words in a window for the repetition measure.
WINDOW = 8

#: bit -> (name, SQL predicate over measurements that is true when the rule fails)
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_density", "10 * n_symbols > 2 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
)
#: Policies: version -> bits that reject a row.
POLICIES = {"base": 0b00011, "v1": 0b11111}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_TRIM = r"' \t\n\u000B\u000C\r'"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of ``text`` to every row."""
    t = "_cm_t"
    out = docs.drop(*MEASURES).withColumn(t, F.coalesce(F.col(text), F.lit("")))
    trimmed = f"btrim({t}, {_TRIM})"
    out = out.withColumn(
        "_cm_w",
        F.expr(f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+'))"),
    ).withColumn("_cm_l", F.expr(f"filter(split({t}, '\\n'), x -> btrim(x, {_TRIM}) != '')"))
    out = out.select(
        "*",
        F.size("_cm_w").cast("long").alias("n_words"),
        F.length(F.array_join("_cm_w", "")).cast("long").alias("word_chars"),
        F.expr(f"size(regexp_extract_all({t}, '[#*$%&|<>]', 0))").cast("long").alias("n_symbols"),
        F.size("_cm_l").cast("long").alias("n_lines"),
        F.expr("size(_cm_l) - size(array_distinct(_cm_l))").cast("long").alias("n_dup_lines"),
        # bits that a window's position takes; the hash keeps the others
        F.expr("length(bin(size(_cm_w)))").alias("_cm_b"),
    )
    return _repeats(out).drop(t, "_cm_w", "_cm_l", "_cm_b")


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words inside any 8-word window that the text holds twice or more.

    Words are hashed once; hashes of two, four and eight words follow from those of half
    as many. Most texts have no two equal window hashes and are done. For the others, one
    long a window holds its hash and, in the low bits, its position. Sorting puts equal
    hashes side by side; only windows with such a neighbour are compared as text, so a
    hash collision never counts.
    """
    df = df.withColumn("_cm_1", F.expr(f"if(size(_cm_w) < {WINDOW}, cast(array() as array<bigint>), transform(_cm_w, x -> xxhash64(x)))"))
    k = 1
    while k < WINDOW:  # a power of two
        df = df.withColumn(f"_cm_{2 * k}", F.expr(f"zip_with(_cm_{k}, slice(_cm_{k}, {k + 1}, greatest(size(_cm_{k}) - {k}, 0)), (a, b) -> xxhash64(a, b))"))
        k *= 2
    df = df.withColumn("_cm_h", F.expr(f"slice(_cm_{WINDOW}, 1, greatest(size(_cm_{WINDOW}) - {WINDOW - 1}, 0))")).withColumn(
        "_cm_h",
        F.expr(
            "if(size(array_distinct(_cm_h)) = size(_cm_h), cast(array() as array<bigint>),"
            " sort_array(transform(_cm_h, (x, i) -> shiftleft(shiftright(x, _cm_b), _cm_b) | cast(i as bigint))))"
        ),
    ).withColumn(
        "_cm_c",
        F.expr(
            "filter(_cm_h, (x, i) -> coalesce(shiftright(get(_cm_h, i - 1), _cm_b) = shiftright(x, _cm_b), false)"
            " or coalesce(shiftright(get(_cm_h, i + 1), _cm_b) = shiftright(x, _cm_b), false))"
        ),
    )
    df = df.withColumn(
        "_cm_e",
        F.expr(
            "array_sort(transform(_cm_c, x -> named_struct('k', array_join(slice(_cm_w,"
            f" cast(x & (shiftleft(1L, _cm_b) - 1) as int) + 1, {WINDOW}), ' '), 'p', cast(x & (shiftleft(1L, _cm_b) - 1) as int))))"
        ),
    ).withColumn(
        "_cm_p",
        F.expr(
            "sort_array(transform(filter(_cm_e, (x, i) -> coalesce(get(_cm_e, i - 1).k = x.k, false)"
            " or coalesce(get(_cm_e, i + 1).k = x.k, false)), x -> x.p))"
        ),
    )
    # spark_partition_id keeps filters above this projection: pushed below it, they
    # would copy the nested arrays above into one expression many times over
    start = "if(spark_partition_id() >= 0, 0L, null)"
    covered = f"transform(_cm_p, (p, i) -> least({WINDOW}, coalesce(get(_cm_p, i + 1) - p, {WINDOW})))"
    return df.withColumn("n_repeat_words", F.expr(f"aggregate({covered}, {start}, (a, x) -> a + x)")).drop("_cm_h", "_cm_c", "_cm_e", "_cm_p", *[f"_cm_{1 << j}" for j in range(WINDOW.bit_length())])


def fail_bits() -> Column:
    """One bit a rule, set where the rule fails."""
    return F.expr(" | ".join(f"if({sql}, {1 << k}L, 0L)" for k, (_, sql) in enumerate(RULES)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``fail_bits``; every rule is evaluated once."""
    return measure(docs, text).drop("fail_bits").withColumn("fail_bits", fail_bits())


def store(led: DataFrame, path: str) -> DataFrame:
    """Write the ledger's rows (doc_id, measurements, fail_bits) under ``path`` and read them back."""
    led.select("doc_id", *MEASURES, "fail_bits").write.mode("append").parquet(path)
    return led.sparkSession.read.parquet(path)


def policy_table(spark: SparkSession, policies: dict[str, int] = POLICIES) -> DataFrame:
    """policy, mask: a row a version."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{p}', {m}L)" for p, m in sorted(policies.items())) + " AS t(policy, mask)")


def masks(policies: DataFrame) -> dict[str, int]:
    """The versions of a policy table; they are few, as each names rules by bits."""
    return {r.policy: r.mask for r in policies.select("policy", "mask").collect()}


def passes(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0


def counts(led: DataFrame) -> DataFrame:
    """Rows for each distinct value of fail_bits: at most 2^rules of them."""
    return led.groupBy("fail_bits").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablation(led: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """For each policy and rule: rows that fail it, and rows that only it rejects.

    Works on ``counts``, so its cost is one aggregation over the ledger's bits. The
    rows of policies times rules are few, and are exploded from literals.
    """
    versions = masks(policies if policies is not None else policy_table(led.sparkSession))
    cells = [(p, m, name, 1 << k) for p, m in sorted(versions.items()) for k, (name, _) in enumerate(RULES) if m >> k & 1]
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for p, m, r, b in cells])).alias("g")
    x = counts(led).select("fail_bits", "n_docs", grid).select("fail_bits", "n_docs", "g.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return x.groupBy("policy", "rule", "bit").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n_docs")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(hit == F.col("bit"), F.col("n_docs")).otherwise(0)).alias("n_only"),
        F.bit_or(F.when(hit != 0, F.col("fail_bits")).otherwise(F.lit(0).cast("long"))).alias("seen_bits"),
    )


def keep(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with their own columns only."""
    cols = docs.columns
    inner = docs.select(F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_cm_row"))
    return ledger(inner).where(passes(POLICIES[policy])).select("_cm_row.*")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), f"{work_folder(spark, 'ledger')}/rows")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, versions = _stored(spark, sf_dir), masks(policy_table(spark))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(versions["base"])).alias("base_failed"), passes(versions["v1"]).alias("kept"), "fail_bits",
    )


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablation of every policy over the stored ledger of all documents."""
    return ablation(_stored(spark, sf_dir))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), win AS (
  SELECT r, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM m WHERE len(w) >= 8)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r
), x AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN cov USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END
           + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
           + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END)::BIGINT AS fail_bits
  FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""

ABLATION_SQL = (
    OP6_SQL[: OP6_SQL.rindex("SELECT doc_id")]
    + """
SELECT policy, rule, bit, sum(CASE WHEN fail_bits & mask & bit <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_fail,
       sum(CASE WHEN fail_bits & mask = bit THEN 1 ELSE 0 END)::BIGINT AS n_only,
       bit_or(CASE WHEN fail_bits & mask <> 0 THEN fail_bits ELSE 0 END)::BIGINT AS seen_bits
FROM b, (VALUES """
    + ", ".join(f"('{p}', {m}::BIGINT, '{r}', {1 << k}::BIGINT)" for p, m in sorted(POLICIES.items()) for k, (r, _) in enumerate(RULES) if m >> k & 1)
    + ") AS g(policy, mask, rule, bit) GROUP BY policy, rule, bit"
)
