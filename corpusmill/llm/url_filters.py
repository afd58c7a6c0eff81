"""URL filters by a temporal list join, in DataFrame expressions only.

List entries are dated events: from a day on, a list adds or removes a key. They
become validity intervals (each add holds until the next event of the same list
and key). A capture gives its keys: the suffixes of its host and, below the host,
the prefixes of its path. The as-of join meets each key with the intervals that
hold at fetch time. The longest key decides; at equal length an ``allow`` entry
wins over ``block``, then the first list by name.

Captures are reduced to distinct (url, day) before their keys are exploded, and
decisions join back on those, so repeated captures of one url or one hot host cost
narrow rows and an adaptive skew join, never a group in one task. The list is
broadcast only after it was counted.

Hosts are compared without case; paths too, so that a block is not evaded by spelling,
unless ``fold_paths`` is off. An address in numbers (IPv4, or IPv6 in brackets) has no
suffixes but itself.

Defined results: a null or unparsable url, or a null day, has no key and passes;
ids are not looked at, so null and repeated ones are kept; a removal without an
addition, or with a null day or key, has no effect; of two events of a list and
key on one day the removal counts; entries that tie in length and verdict are ranked by
list; a very long url gives a key for each step of its path; empty tables give an empty
result (pages) or pass everything (list); other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.staging import small_or_shuffled, splittable, table

#: (list, key, action, day, verdict): key is a host suffix, or host suffix + path prefix.
ENTRIES = (
    ("adult", "example.net", "add", "2024-02-01", "block"),
    ("adult", "example.net", "remove", "2024-05-01", "block"),
    ("adult", "example.net", "add", "2024-09-01", "block"),
    ("malware", "org", "add", "2024-03-15", "block"),
    ("malware", "org", "remove", "2024-03-29", "block"),
    ("malware", "example.org/de", "add", "2024-01-01", "block"),
    ("malware", "example.org/de", "remove", "2024-12-01", "block"),
    ("spam", "example.com/fr", "add", "2024-04-01", "block"),
    ("spam", "example.com/fr", "remove", "2024-08-01", "block"),
    ("spam", "example.com/es", "add", "2024-06-01", "block"),
    ("trusted", "m.ththth.example.net", "add", "2024-01-01", "allow"),
    ("trusted", "example.org/en", "add", "2024-02-01", "allow"),
    ("trusted", "example.org/en", "remove", "2024-07-01", "allow"),
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def entry_table(spark: SparkSession, entries: tuple = ENTRIES) -> DataFrame:
    """The dated events as rows; a production list is a table of the same columns."""
    quoted = ", ".join("(" + ", ".join("null" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in e) + ")" for e in entries)
    columns = "list, key, action, day, verdict"
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t({columns})" if entries else "SELECT " + ", ".join(f"cast(null AS string) AS {c}" for c in columns.split(", ")) + " WHERE false")
    return rows.withColumn("day", F.try_to_date("day"))


def intervals(entries: DataFrame, fold_paths: bool = True) -> DataFrame:
    """list, key, verdict, valid_from, valid_to (null: still valid) from dated events."""
    e = entries.where("key is not null and day is not null and action in ('add', 'remove')").withColumn("key", F.lower("key") if fold_paths else _folded("key"))
    # one event a day, list and key: max('add', 'remove') is the removal
    e = e.groupBy("list", "key", "day").agg(F.max_by("verdict", "action").alias("verdict"), F.max("action").alias("action"))
    later = Window.partitionBy("list", "key").orderBy("day")
    e = e.withColumn("valid_to", F.lead("day").over(later))
    return e.where("action = 'add'").select("list", "key", "verdict", F.col("day").alias("valid_from"), "valid_to")


def _folded(key: str) -> Column:
    """The key with its host in lower case."""
    return F.expr(f"concat(lower(substring_index(`{key}`, '/', 1)), substring(`{key}`, length(substring_index(`{key}`, '/', 1)) + 1))")


def keys(captures: DataFrame, fold_paths: bool = True) -> DataFrame:
    """url, day, host, key: a row for each host suffix and path prefix of distinct captures."""
    x = captures.select("url", "day").distinct().where("url is not null and day is not null")
    x = x.withColumn("host", F.lower(F.regexp_extract("url", HOST, 1))).where("host != ''")
    path = f"lower(regexp_extract(url, r'{PATH}', 1))" if fold_paths else f"regexp_extract(url, r'{PATH}', 1)"
    number = F.col("host").rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*)$")
    x = x.withColumn("labels", F.when(number, F.array("host")).otherwise(F.split("host", r"\."))).withColumn("steps", F.expr(f"filter(split({path}, '/'), s -> s != '')"))
    x = x.withColumn("suffix", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")))
    paths = "transform(sequence(0, size(steps)), n -> if(n = 0, suffix, concat(suffix, '/', array_join(slice(steps, 1, n), '/'))))"
    return x.select("url", "day", F.explode(F.expr(paths)).alias("key"))


def decide(captures: DataFrame, entries: DataFrame, fold_paths: bool = True) -> DataFrame:
    """``captures`` (page_id, url, day) with blocked, n_active, list, entry, verdict, valid_from."""
    spans = small_or_shuffled(intervals(entries, fold_paths))
    active = keys(captures, fold_paths).join(spans, "key").where("valid_from <= day and (valid_to is null or day < valid_to)")
    # smallest first: longest key, then allow before block, then the list's name
    best = F.min(F.struct((-F.length("key")).alias("rank"), "verdict", "list", F.col("key").alias("entry"), "valid_from")).alias("m")
    found = active.groupBy("url", "day").agg(F.count("*").alias("n_active"), best)
    found = found.select("url", "day", "n_active", "m.list", "m.entry", "m.verdict", "m.valid_from")
    x = splittable(captures.select("page_id", "url", "day"), found, ["url", "day"], "left")
    return x.select("page_id", "url", "day", F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "list", "entry", "verdict", "valid_from")


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures with a fetch day: the pages table has none, so page_id deals out the days of 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("day"))


#: Cycles of the generated list, and the days between their beginnings.
CYCLES, PERIOD = 8, 45


def events_of(pages: DataFrame) -> DataFrame:
    """A list of dated events from the hosts and first path steps of ``pages`` (url), as there is no list table.

    Each key is added and removed ``CYCLES`` times, on days that follow from its digest; every fifth is allowed.
    """
    x = pages.where("url is not null").select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), F.get(F.expr(f"filter(split(lower(regexp_extract(url, r'{PATH}', 1)), '/'), s -> s != '')"), 0).alias("step")).where("host != ''")
    # a hot host is one row a task before it is shuffled
    x = x.distinct().select(F.explode(F.array_compact(F.array("host", F.concat("host", F.lit("/"), "step")))).alias("key")).distinct()
    n = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int")
    x = x.withColumn("n", n).select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(CYCLES - 1))).alias("c"))
    begin = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") % 60 + F.col("c") * PERIOD).cast("int"))
    end = F.date_add(begin, (F.col("n") % 70 + 10).cast("int"))
    x = x.select(F.when(F.col("n") % 2 == 0, "even").otherwise("odd").alias("list"), "key", F.when(F.col("n") % 5 == 0, "allow").otherwise("block").alias("verdict"), F.array(F.struct(F.lit("add").alias("action"), begin.alias("day")), F.struct(F.lit("remove").alias("action"), end.alias("day"))).alias("e"))
    return x.select("list", "key", "verdict", F.inline("e")).select("list", "key", "action", "day", "verdict")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return decide(captures_of(pages), entry_table(spark).unionByName(events_of(pages)))


OP7_SQL = r"""
WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '%(host)s', 1)) AS host, list_filter(string_split(lower(regexp_extract(url, '%(path)s', 1)), '/'), lambda s: s <> '')[1] AS step FROM pages WHERE url IS NOT NULL),
keyed AS (SELECT DISTINCT unnest(list_filter([host, host || '/' || step], lambda k: k IS NOT NULL)) AS key FROM hosts WHERE host <> ''),
made AS (SELECT key, ('0x' || substr(md5(key), 1, 6))::INTEGER AS n, unnest(range(%(cycles)s)) AS c FROM keyed),
dated AS (SELECT CASE WHEN n %% 2 = 0 THEN 'even' ELSE 'odd' END AS list, key, CASE WHEN n %% 5 = 0 THEN 'allow' ELSE 'block' END AS verdict, DATE '2024-01-01' + (n %% 60 + c * %(period)s)::INTEGER AS begin, (n %% 70 + 10)::INTEGER AS days FROM made),
e AS (SELECT list, key, action, day::DATE AS day, verdict FROM (VALUES %(values)s) AS t(list, key, action, day, verdict)
  UNION ALL SELECT list, key, 'add', begin::DATE, verdict FROM dated UNION ALL SELECT list, key, 'remove', (begin + days)::DATE, verdict FROM dated),
one AS (SELECT list, key, day, max(action) AS action, arg_max(verdict, action) AS verdict FROM e GROUP BY list, key, day),
span AS MATERIALIZED (
  SELECT *, split_part(key, '/', 1) AS host FROM (
    SELECT list, key, action, day AS valid_from, verdict, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS valid_to FROM one
  ) WHERE action = 'add'
),
cap AS (
  SELECT page_id, url, (DATE '2024-01-01' + (page_id %% 366)::INTEGER)::DATE AS day,
         lower(regexp_extract(url, '%(host)s', 1)) AS host,
         lower(regexp_extract(url, '%(path)s', 1)) AS path
  FROM pages
),
hit AS (
  SELECT cap.page_id, s.list, s.key, s.verdict, s.valid_from,
         row_number() OVER (PARTITION BY cap.page_id ORDER BY length(s.key) DESC, s.verdict, s.list) AS rn,
         count(*) OVER (PARTITION BY cap.page_id) AS n
  FROM (SELECT *, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS suffix FROM cap) AS cap JOIN span s
    ON cap.suffix = s.host
   AND (NOT contains(s.key, '/') OR cap.path = s.key[strpos(s.key, '/'):] OR starts_with(cap.path, s.key[strpos(s.key, '/'):] || '/'))
   AND s.valid_from <= cap.day AND (s.valid_to IS NULL OR cap.day < s.valid_to)
)
SELECT cap.page_id, url, day, coalesce(hit.verdict = 'block', false) AS blocked,
       coalesce(hit.n, 0)::BIGINT AS n_active, hit.list, hit.key AS entry, hit.verdict, hit.valid_from
FROM cap LEFT JOIN hit ON hit.page_id = cap.page_id AND hit.rn = 1
""" % {"cycles": CYCLES, "period": PERIOD, "values": ", ".join(str(e) for e in ENTRIES), "host": HOST, "path": PATH}
