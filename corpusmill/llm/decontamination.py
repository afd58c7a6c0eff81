"""Benchmark decontamination by template windows with slot consistency.

A text becomes a sequence of word codes in which numbers, names and units are
typed placeholders, so that a question with other numbers or names has the same
template. Windows of five codes are hashed and joined with the windows of the
benchmark items. A document holds an item if it has at least 0.8 of the item's
windows and the values behind matching placeholders correspond: each value of the
item must map to one value of the document in at least 0.8 of its occurrences.
All values equal is ``verbatim``; other consistent values ``reparameterised``.

A document is a row: (doc_id, digest of the text) keys all windows, so rows that
share an id, or have none, never add up to an item that none of them holds.

Documents' windows pass a set of the benchmark's window hashes before they leave
the scan. The set is collected only if it has at most ``FILTER_ROWS`` hashes; a
larger benchmark is joined without it, with the same result. Pairs of document and
item are found by the item's rarest windows alone: whoever holds 0.8 of n windows
holds one of any 0.2 n + 1 of them, so a template that many items and documents
share multiplies nothing. Only those pairs meet all their windows.

Items of which less than half of the windows are templates (arithmetic, lists of
names) are also matched by windows of their literal words.

Defined results: null and empty texts have no windows; items of fewer than five
words have none and match nothing; rows with null ids report under a null id;
rows that repeat an id report once, with their best match; empty tables give an
empty result; other columns, whatever their names, are not read by ``matches`` and
pass through ``clean``. A very long text is read in pieces cut between words, and
word positions run on over the pieces, so its size changes no result. Of matches that
tie, the first copy in the text counts. Template windows with fewer than three plain
words (tables of figures) count for neither side. A character of a script without
spaces is a word. Every capitalised word is taken for a name, so that lost punctuation
changes no template; the first window of an item that opens with one is left out, as
inside a sentence that word may be in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.process_cache import frugal
from corpusmill.plans.staging import cut, small_batches, small_or_shuffled, table

WINDOW = 5
COVER = 0.8
CONSISTENT = 0.8
PLAIN = 3
#: Words by which neighbouring matches of one copy may shift.
DRIFT = 8
#: Most hashes (8 bytes each) that the filter of the scan may hold.
FILTER_ROWS = 4_000_000
#: Characters handled at a time; a longer text is cut between words into pieces that overlap.
CHUNK = 500_000
OVERLAP = 4_000
#: Share of template windows below which an item is matched by its literal words too.
TEMPLATES = 0.5

# Spelled numbers and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
UNITS = frozenset("mm cm m km in ft yd mi inches feet foot yards miles meters metres kilometers kilometres mg g kg lb lbs oz grams kilograms pounds ounces ml l liters litres gallons s sec seconds min minutes h hr hours days weeks months years percent dollars cents euros usd eur degrees mph kph kmh w kw v hz khz mhz ghz kb mb gb tb".split())

# a character of these scripts is a word: Thai to Khmer, kana, ideographs
_ALONE = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_TOKEN = rf"\x00|\d+(?:[.,:/]\d+)*(?![^\W\d_])|[^\W_{_ALONE}]+|[{_ALONE}]"
_END, _PLAIN, _NAME, _NUM, _UNIT = range(5)
_NUM_CODE, _NAME_CODE, _UNIT_CODE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_STEP = 0x2545F4914F6CDD1D
#: Tells hashes of literal windows from those of templates.
_LITERAL = 0xD6E8FEB86659FD93


class _Words(dict):
    """word -> id, with the kind and code of each id; emptied when it gets large."""

    #: Words kept at a time: some 30 MB in a worker.
    LIMIT = 150_000

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.kinds, self.codes = np.empty(0, np.int8), np.empty(0, np.uint64)
        self.new_kinds: list[int] = []
        self.new_codes: list[int] = []

    def ids(self, raw: list[str]) -> np.ndarray:
        """The ids of ``raw``; afterwards ``kinds`` and ``codes`` cover them."""
        if len(self) > self.LIMIT:
            self.reset()
        out = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        if self.new_kinds:
            self.kinds = np.concatenate((self.kinds, np.array(self.new_kinds, np.int8)))
            self.codes = np.concatenate((self.codes, np.array(self.new_codes, np.uint64)))
            self.new_kinds, self.new_codes = [], []
        return out

    def __missing__(self, w: str) -> int:
        import xxhash

        low = w.lower()
        if w == "\x00":
            kind = _END
        elif low in NUMBER_WORDS or w[0].isdigit() and re.fullmatch(r"\d+(?:[.,:/]\d+)*", w):
            kind = _NUM
        elif low in UNITS:
            kind = _UNIT
        elif len(w) > 1 and w[0].isupper() and not w.isupper():
            kind = _NAME
        else:
            kind = _PLAIN
        n = self[w] = len(self)
        self.new_kinds.append(kind)
        self.new_codes.append(xxhash.xxh64_intdigest(low.encode(errors="replace"), 7))
        return n


def _windows(texts: list[str], words: _Words, find, literal: bool = False) -> tuple:
    """Of all texts together: hash, text number, word number of each window; words, slots; word numbers in the texts; literal or not.

    Texts hold no NUL character. With ``literal``, windows of the words as they are
    come after the templates.
    """
    raw = find("\x00".join(texts))
    ids = words.ids(raw)
    kinds = words.kinds[ids]
    doc = np.cumsum(kinds == _END)
    real = np.nonzero(kinds != _END)[0]
    kinds, doc = kinds[real], doc[real]
    codes = words.codes[ids[real]]
    plain_codes = codes.copy() if literal else codes
    after_number = np.zeros(len(real), bool)
    after_number[1:] = (kinds[:-1] == _NUM) & (doc[:-1] == doc[1:])
    num, name, unit = kinds == _NUM, kinds == _NAME, (kinds == _UNIT) & after_number
    for at, code in ((num, _NUM_CODE), (name, _NAME_CODE), (unit, _UNIT_CODE)):
        codes[at] = np.uint64(code)
    slot = num | name | unit
    n = len(real) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), raw, real, slot, np.empty(0, np.int64), np.empty(0, bool)

    def rolled(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(_STEP) + codes[k : k + n]
        return h ^ h >> np.uint64(31)

    plain = sum((~slot[k : k + n]).astype(np.int8) for k in range(WINDOW))
    whole = doc[:n] == doc[WINDOW - 1 :]
    at = np.nonzero(whole & (plain >= PLAIN))[0]
    h = rolled(codes)[at]
    exact = np.zeros(len(at), bool)
    if literal:
        more = np.nonzero(whole)[0]
        h, at = np.concatenate((h, rolled(plain_codes)[more] ^ np.uint64(_LITERAL))), np.concatenate((at, more))
        exact = np.concatenate((exact, np.ones(len(more), bool)))
    first = np.searchsorted(doc, np.arange(len(texts)))
    return h, doc[at], at, raw, real, slot, at - first[doc[at]], exact


# where no token can be cut
_GAP = re.compile(rf"\s|(?<=[{_ALONE}])")


def _placed(text: str, find) -> Iterator[tuple[int, str]]:
    """(words before, piece) of a text. Pieces are cut between words, and a later one
    begins with what the one before ended with: ``OVERLAP`` characters and a window of words."""
    text = text.replace("\x00", " ")
    start, words, end = 0, 0, 0
    while end < len(text) or not start:
        gap = _GAP.search(text, end + CHUNK) if end + CHUNK < len(text) else None
        last, end = end, gap.start() if gap else len(text)
        if last:
            again, at = OVERLAP, 0
            while again < 2 * last:
                gap = _GAP.search(text, max(0, last - again), last) if again < last else None
                at = gap.start() if gap else 0 if again >= last else last
                if len(find(text[at:last])) > WINDOW:
                    break
                again *= 2
            else:
                at = 0
            at = max(at, start)
            words += len(find(text[start:at]))
            start = at
        yield words, text[start:end]
        if end >= len(text):
            return


def _pieces(text: str) -> Iterator[str]:
    for _, piece in _placed(text, re.compile(_TOKEN).findall):
        yield piece


def _slots(i: int, raw: list, real: np.ndarray, slot: np.ndarray) -> list[str]:
    """offset:value of each placeholder in the window at word i."""
    return [f"{j}:{raw[real[i + j]].lower()}" for j in range(WINDOW) if slot[i + j]]


def benchmark_windows(items: DataFrame) -> DataFrame:
    """h, item, item_pos, slots, n_windows: the distinct windows of every item.

    ``item`` is (item_id, item_row, variant), item_row a digest of the text. Variant 1 is
    the item in lower case, for texts that lost their capitals; variant 2 its literal
    words, for items with few templates.
    """
    schema = pa.schema([("h", pa.int64()), ("item_id", pa.int64()), ("item_row", pa.int64()), ("variant", pa.int32()), ("item_pos", pa.int64()), ("slots", pa.list_(pa.string())), ("n_windows", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, words = re.compile(_TOKEN).findall, _Words()
        for b in batches:
            out = {c: [] for c in schema.names}
            for item, row, text in zip(*[b.column(c).to_pylist() for c in ("item_id", "item_row", "text")]):
                seen = None
                text = (text or "").replace("\x00", " ")
                for variant, t in enumerate((text, text.lower(), text)):
                    h, _, at, raw, real, slot, _, exact = _windows([t], words, find, variant == 2)
                    if variant == 2:
                        if (~exact).sum() >= TEMPLATES * exact.sum():
                            continue
                        h, at, slot = h[exact], at[exact], np.zeros(len(slot), bool)
                    elif len(h) > 1 and at[0] == 0 and raw[real[0]][0].isupper():
                        h, at = h[1:], at[1:]
                    first = dict(zip(reversed(h.tolist()), reversed(at.tolist())))
                    if set(first) == seen or not first:
                        continue
                    seen = set(first)
                    for x, i in first.items():
                        for k, v in zip(out, (x - (1 << 64) if x >> 63 else x, item, row, variant, i, _slots(i, raw, real, slot), len(first))):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), _digest("text").alias("item_row"), "text")
    found = rows.mapInArrow(run, "h long, item_id long, item_row long, variant int, item_pos long, slots array<string>, n_windows int")
    # rows equal in id and text are one item
    return found.select("h", F.struct("item_id", "item_row", "variant").alias("item"), "item_pos", "slots", "n_windows").distinct()


def _digest(text: str) -> Column:
    """Of the text as it is, so that a row can be named without moving its text."""
    return F.xxhash64(F.col(f"`{text}`"))


def document_windows(docs: DataFrame, only: np.ndarray | None, literal: bool = False) -> DataFrame:
    """doc, h, pos, slots of the windows of ``docs`` (doc_id, text) whose hash is in ``only``.

    ``doc`` is (doc_id, row), row a digest of the whole text; ``pos`` counts its words.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, words, only = re.compile(_TOKEN).findall, _Words(), shared.value
        if only is not None:
            low = np.zeros(1 << 22, bool)
            low[only & np.uint64((1 << 22) - 1)] = True

        def flush(held: list) -> pa.RecordBatch:
            ids, rows, before, texts = zip(*held)
            h, doc, at, raw, real, slot, pos, exact = _windows(texts, words, find, literal)
            if only is not None and len(h):
                hit = np.nonzero(low[h & np.uint64((1 << 22) - 1)])[0]
                hit = hit[np.isin(h[hit], only)] if len(hit) else hit
                h, doc, at, pos, exact = h[hit], doc[hit], at[hit], pos[hit], exact[hit]
            slots = [[] if e else _slots(i, raw, real, slot) for i, e in zip(at.tolist(), exact.tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array([rows[d] for d in doc.tolist()], pa.int64()), pa.array(h.view(np.int64)), pa.array(pos + np.array(before, np.int64)[doc], pa.int64()), pa.array(slots, pa.list_(pa.string()))],
                names=["doc_id", "row", "h", "pos", "slots"],
            )

        for b in batches:
            held, size = [], 0
            for i, r, t in zip(b.column("doc_id"), b.column("row"), b.column("text")):
                for before, piece in _placed(t.as_py() or "", find):
                    held.append((i.as_py(), r.as_py(), before, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text").alias("row"), "text")
    found = rows.mapInArrow(frugal(run), "doc_id long, row long, h long, pos long, slots array<string>")
    return found.select(F.struct("doc_id", "row").alias("doc"), "h", "pos", "slots")


def candidates(hits: DataFrame, bench: DataFrame, cover: float = COVER) -> DataFrame:
    """Distinct (doc, item) that share one of the item's rarest windows.

    Of n windows, a document that holds ``cover`` of them misses so few that it holds one
    of any n - ceil(cover * n) + 1; the rarest ones in these documents are looked up.
    """
    often = hits.groupBy("h").agg(F.count("*").alias("often"))
    order = Window.partitionBy("item").orderBy(F.coalesce("often", F.lit(0)), "h")
    ranked = bench.select("h", "item", "n_windows").join(often, "h", "left").withColumn("place", F.row_number().over(order))
    # the small term keeps a product like 12.000000000000002 from rounding up
    rare = ranked.where(F.col("place") <= F.col("n_windows") - F.ceil(F.col("n_windows") * F.lit(float(cover)) - F.lit(1e-6)) + 1).where("often is not null")
    return hits.select("doc", "h").join(small_or_shuffled(cut(rare.select("h", "item"))), "h").select("doc", "item").distinct()


def row_matches(docs: DataFrame, items: DataFrame, cover: float = COVER, consistent: float = CONSISTENT) -> DataFrame:
    """doc (doc_id, row), item (item_id, item_row, variant), coverage, consistency, kind."""
    bench = cut(benchmark_windows(items))
    hashes = bench.select("h").distinct()
    only = None
    if hashes.limit(FILTER_ROWS + 1).count() <= FILTER_ROWS:
        only = np.sort(np.array([r.h for r in hashes.toLocalIterator()], np.int64).view(np.uint64))
    literal = bench.where("item.variant = 2").limit(1).count() > 0
    hits = document_windows(docs, only, literal)
    hits = cut(hits if only is not None else hits.join(hashes, "h", "left_semi"))
    theirs = bench.withColumnRenamed("slots", "item_slots")
    pairs = candidates(hits, bench, cover).join(small_or_shuffled(theirs), "item")
    joined = cut(pairs.join(hits, ["doc", "h"]).withColumn("diagonal", F.col("pos") - F.col("item_pos")))
    key = ["doc", "item"]
    held = joined.groupBy(*key).agg(F.countDistinct("h").alias("n"), F.max("n_windows").alias("n_windows")).withColumn("coverage", F.col("n") / F.col("n_windows")).where(F.col("coverage") >= cover)
    # matches of one copy share a diagonal, but for a few inserted or missing words
    along = Window.partitionBy(*key).orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT).cast("int")
    chained = joined.withColumn("starts", F.coalesce(starts, F.lit(0))).withColumn("copy", F.sum("starts").over(along.rangeBetween(Window.unboundedPreceding, 0)))
    # short items back to back have near diagonals too: read along the text, a copy also ends where item positions restart
    inside = Window.partitionBy(*key).orderBy("pos")
    step = lambda c: F.col(c) - F.lag(c).over(inside)
    starts = ((step("pos") > 0) & ((step("item_pos") <= 0) | (F.abs(step("diagonal")) > DRIFT))).cast("int")
    restarted = joined.withColumn("starts", F.coalesce(starts, F.lit(0))).withColumn("copy", F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    copies = chained.withColumn("way", F.lit(0)).unionByName(restarted.withColumn("way", F.lit(1)))
    one = [*key, "way", "copy"]
    size = copies.groupBy(*one).agg(F.countDistinct("h").alias("here"), F.countDistinct(F.when(F.col("slots") == F.col("item_slots"), F.col("h"))).alias("equal"))
    values = copies.where("size(slots) > 0").select(*one, "item_pos", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    at = F.col("item_pos") + F.substring("s.item_slots", 1, 1).cast("long")
    values = values.select(*one, at.alias("at"), F.expr("substring(s.item_slots, 3)").alias("a"), F.expr("substring(s.slots, 3)").alias("b")).distinct()
    values = values.groupBy(*one, "a", "b").count().groupBy(*one, "a").agg((F.max("count") / F.sum("count")).alias("agree"))
    values = values.groupBy(*one).agg(F.min("agree").alias("agree"))
    both = size.join(held, key).join(values, one, "left").withColumn("consistency", F.coalesce("agree", F.lit(1.0)))
    verbatim = F.col("equal") / F.col("n_windows") >= cover
    both = both.withColumn("kind", F.when(verbatim, "verbatim").otherwise("reparameterised")).withColumn("ok", verbatim | (F.col("consistency") >= consistent))
    # any copy that holds enough of the item by itself may pass; of these, or else of all, the one
    # with the most windows, then the most equal ones, then the first
    rank = F.struct(F.col("ok") & (F.col("here") / F.col("n_windows") >= cover), "here", "equal", -F.col("way"), -F.col("copy"))
    return both.groupBy(*key).agg(F.max_by(F.struct("coverage", "consistency", "kind", "ok"), rank).alias("m")).select(*key, "m.*").where("ok").drop("ok")


def matches(docs: DataFrame, items: DataFrame, cover: float = COVER, consistent: float = CONSISTENT) -> DataFrame:
    """doc_id, item_id, coverage, consistency, kind: the items that documents hold, the best match of each."""
    best = F.max(F.struct("coverage", "consistency", "kind")).alias("m")
    found = row_matches(docs, items, cover, consistent).groupBy(F.col("doc.doc_id").alias("doc_id"), F.col("item.item_id").alias("item_id")).agg(best)
    return found.select("doc_id", "item_id", "m.coverage", "m.consistency", "m.kind")


def clean(docs: DataFrame, items: DataFrame, null_ids: bool = False) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item. Rows with null ids stay unless ``null_ids``."""
    bad = row_matches(docs.select("doc_id", "text"), items).select(F.col("doc.doc_id").alias("_cm_id"), F.col("doc.row").alias("_cm_row")).distinct()
    bad = small_or_shuffled(cut(bad if null_ids else bad.where("_cm_id is not null")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_cm_id"]) & (_digest("text") == bad["_cm_row"]), "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
