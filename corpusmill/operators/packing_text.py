"""Group paragraphs into budgeted pieces; split enumerated provisions.

A document is one row and is never gathered with others.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, count, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Budgets in estimated tokens, and the bounds of the enumerated split.
BUDGET, MANUAL_BUDGET, OVERLAP, HARD_SPLIT = 700, 330, 80, 1.6
ENUM_ITEMS, ENUM_TOKENS, STEM_WORDS = 4, 400, 120
#: The fewest words that are so many tokens.
ENUM_WORDS = next(n for n in count() if int(n * T.TOKENS_PER_WORD) >= ENUM_TOKENS)


def tokens(s: str) -> int:
    return int(len(s.split()) * T.TOKENS_PER_WORD)


def _fitting(costs: list[int], budget: int, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) over consecutive units whose costs add up to the budget at most.

    A range takes one new unit at least, whatever it costs. With ``overlap`` the next range
    goes back over the fewest units that cost that much, one at least.
    """
    upto = [0, *accumulate(costs)]
    lo = hi = 0
    while hi < len(costs):
        hi = max(hi + 1, bisect_right(upto, upto[lo] + budget) - 1)
        yield lo, hi
        lo = min(hi - 1, max(lo, bisect_right(upto, upto[hi] - overlap) - 1)) if overlap else hi


def stem_and_items(piece: Column) -> Column:
    """array<struct<served, embedded>> of a piece: its stem and its items, or the piece as it is.

    A piece of enough tokens, with words before the first of enough items, is split before
    each item. Items are served behind the header line (if it cites) and the last words
    of the stem, and embedded alone.
    """
    pair = lambda served, embedded: F.struct(served.alias("served"), embedded.alias("embedded"))
    # a lambda binds what is used more than once: without it a value is made anew for each use
    let = lambda value, of: F.get(F.transform(F.array(value), of), 0)

    def lead(stem: Column, first: Column) -> Column:
        cites = first.contains("§") | first.contains("SEC.")
        body = F.when(cites, F.substr(stem, F.length(first) + 2)).otherwise(stem)
        last = T.last_words(body, STEM_WORDS)
        return F.trim(F.concat_ws(" ", F.when(cites, first), last))

    def split(x: Column) -> Column:
        items = F.slice(x, F.lit(2), F.size(x))
        served = lambda l: F.transform(items, lambda i: let(F.btrim(i, F.lit(T.SPACE)), lambda i: pair(F.concat_ws(" ", l, i), i)))
        apart = lambda stem: F.concat(F.array(pair(stem, stem)), let(let(F.substring_index(stem, "\n", 1), lambda f: lead(stem, f)), served))
        enough = (F.size(x) > ENUM_ITEMS) & T.at_least_words(piece, ENUM_WORDS)
        whole = F.array(pair(piece, piece))
        return F.when(enough, let(F.rtrim(F.get(x, 0), F.lit(T.SPACE)), lambda stem: F.when(stem != "", apart(stem)).otherwise(whole))).otherwise(whole)

    # most pieces have no bracket and are not split
    return F.when(piece.contains("("), let(F.split(piece, f"(?={T.ENUM_ITEM})"), split)).otherwise(F.array(pair(piece, piece)))


def pieces(paragraphs: list[str], budget: int = BUDGET, overlap: int = OVERLAP) -> list[str]:
    """Whole paragraphs joined up to the budget, some of the last piece carried over.

    A paragraph over 1.6 budgets is cut at sentences and joins no other. Pieces keep the
    order of the text (a deliberate difference from engines that emit the oversized
    paragraph first).
    """
    if sum((len(p) + 1) // 2 * T.TOKENS_PER_WORD for p in paragraphs) <= budget:  # a word and its space are two characters at least
        return [p for p in [" ".join(paragraphs)] if p.strip()]
    out: list[str] = []
    for big, run in groupby([(p, tokens(p)) for p in paragraphs], lambda p: p[1] > HARD_SPLIT * budget):
        groups = [[(u, tokens(u)) for u in re.split(T.SENTENCE, p)] for p, _ in run] if big else [list(run)]
        for units in groups:
            out += [" ".join(u for u, _ in units[lo:hi]) for lo, hi in _fitting([n for _, n in units], budget, 0 if big else overlap)]
    return [p for p in out if p.strip()]


def packed(docs: DataFrame, id_col: str = "doc_id", paragraphs: str = "paragraphs", budget: int = BUDGET, overlap: int = OVERLAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, *carry, piece, text, embed_text) for an array of paragraphs a row; embed_text is
    '' where it equals the text. ``carry`` names string columns that go along.

    Joining paragraphs is an ordered fold and runs on Arrow batches; enumerated pieces are
    split by column expressions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([pieces(ps.as_py() or [], budget, overlap) for ps in b.column("ps")], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", *carry)], found], names=["id", *carry, "pieces"])

    schema = ", ".join(["id long", *(f"`{c}` string" for c in carry), "pieces array<string>"])
    x = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in carry], F.col(paragraphs).alias("ps"))
    x = x.mapInArrow(run, schema).where(F.size("pieces") > 0).withColumn("pairs", F.flatten(F.transform("pieces", stem_and_items)))
    # no piece is without pairs; a plain posexplode would make them twice, the first time to look for empty arrays
    x = x.select("id", *[F.col(f"`{c}`") for c in carry], F.posexplode_outer("pairs").alias("piece", "p"))
    return x.select("id", *[F.col(f"`{c}`") for c in carry], "piece", F.col("p.served").alias("text"), F.when(F.col("p.embedded") == F.col("p.served"), "").otherwise(F.col("p.embedded")).alias("embed_text"))
