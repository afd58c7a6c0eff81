"""Turns, budgets and prompt assembly on conversation rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.plans.numbering import running

# Carried turns and their tokens, and the prompt's budget.
TURNS, HISTORY, WINDOW, RESERVE = 3, 700, 16384, 1400


def questions(conv: DataFrame) -> DataFrame:
    return conv.where("role = 'user'").select("conv_id", "turn", "text")


def recent(conv: DataFrame, n: int = TURNS) -> DataFrame:
    """The last n questions of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return questions(conv).withColumn("back", F.row_number().over(w).cast("long")).where(F.col("back") <= n)


def with_previous(conv: DataFrame) -> DataFrame:
    """Each question with what to search for: the previous one is put before it only if
    it cannot stand alone."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("text").over(w)
    x = questions(conv).withColumn("before", before)
    return x.withColumn("query", F.when(F.col("before").isNotNull() & T.needs_context(F.col("text")), F.concat("before", F.lit(" "), "text")).otherwise(F.col("text")))


def history(conv: DataFrame, n: int = TURNS, tokens: int = HISTORY) -> DataFrame:
    """(conv_id, kept, body): the newest of the last n questions that fit, oldest dropped
    first, the newest always kept. The estimate is over the joined body with bullets."""
    w = Window.partitionBy("conv_id").orderBy("back").rowsBetween(Window.unboundedPreceding, 0)
    x = recent(conv, n).withColumn("line", F.concat(F.lit("- "), T.clean(F.col("text"))))
    x = x.withColumn("words", F.sum(T.n_words(F.col("line"))).over(w))
    x = x.where((F.col("back") == 1) | (F.floor(F.col("words") * T.TOKENS_PER_WORD) <= tokens))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n")
    return x.groupBy("conv_id").agg(F.count("*").alias("kept"), body.alias("body"))


def fits(rows: DataFrame, budget: int, key: str, order: str, cost: Column) -> DataFrame:
    """Rows of each key while their running cost fits; the first always, none after the
    first that does not (no skipping ahead)."""
    w = Window.partitionBy(key).orderBy(order)
    run = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = rows.withColumn("_run", run).withColumn("_first", F.row_number().over(w) == 1)
    # running cost never falls, so every row after the first breach breaches too
    return x.where(F.col("_first") | (F.col("_run") <= budget)).withColumn("used", F.col("_run")).drop("_run", "_first")


def fits_spread(rows: DataFrame, budget: int, key: str, order: str, cost: Column) -> DataFrame:
    """``fits`` for keys that may hold most of a table: the running cost is summed over ranges."""
    x = running(rows.withColumn("_cost", cost), "_cost", [order], [key], "used")
    first = x.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    y = x.join(first, x[key].eqNullSafe(first["_key"]))
    return y.where((F.col(order) == F.col("_first")) | (F.col("used") <= budget)).drop("_cost", "_key", "_first")


def condensed(texts: DataFrame, tokens: int, id_col: str = "id") -> DataFrame:
    """Whole leading sentences of each text within a budget; the first always kept."""
    x = texts.select(id_col, F.posexplode(T.sentences(F.col("text"))).alias("n", "s"))
    x = fits(x, tokens, id_col, "n", T.n_tokens(F.col("s")))
    return x.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda r: r["s"]), " ").alias("text"))


def fold_system(conv: DataFrame) -> DataFrame:
    """System text joins the next user row; assistant rows pass; a trailing system text
    becomes a user row. Rows keep the turn of the row they join."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    is_user = (F.col("role") == "user").cast("int")
    # user rows strictly before this one: system rows share the next user row's number
    x = conv.withColumn("g", F.coalesce(F.sum(is_user).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    passed = x.where("role not in ('user', 'system')").select("conv_id", "turn", "role", "text")
    joined = x.where("role in ('user', 'system')").groupBy("conv_id", "g").agg(F.max("turn").alias("turn"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "\n\n").alias("text"))
    return joined.select("conv_id", "turn", F.lit("user").alias("role"), "text").unionByName(passed)


def prompt(slate: DataFrame, budget: int = WINDOW - RESERVE) -> DataFrame:
    """(q, prompt, n_sources) from (q, rank, citation, served): numbered sources in order
    while they fit; a suspended source keeps its number."""
    text = F.when(F.col("served") == "", "(withheld: not in force)").otherwise(F.col("served"))
    x = slate.withColumn("line", F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("citation"), F.lit("\n"), text))
    x = fits(x, budget, "q", "rank", T.n_tokens(F.col("line")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"])
    return x.groupBy("q").agg(F.array_join(lines, "\n\n").alias("prompt"), F.count("*").alias("n_sources"))


def numbered(slate: DataFrame, tiers: DataFrame) -> DataFrame:
    """(q, n, citation, tier_name, cosine) for display; the tier table has five rows."""
    w = Window.partitionBy("q").orderBy("rank")
    return slate.join(F.broadcast(tiers), "tier", "left").select("q", F.row_number().over(w).cast("long").alias("n"), "citation", F.coalesce("tier_name", F.lit("unknown")).alias("tier_name"), F.format_number("cosine", 2).alias("cosine"))


def labels(slate: DataFrame, quotes: DataFrame) -> DataFrame:
    """(q, n, citation): slate rows, then the sources that decided rules quote."""
    size = slate.groupBy("q").agg(F.count("*").alias("size"))
    more = quotes.join(size, "q").select("q", (F.col("size") + F.col("ord") + 1).alias("n"), "citation")
    return slate.select("q", F.col("rank").alias("n"), "citation").unionByName(more)
