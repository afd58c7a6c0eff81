"""Answers checked against the passages they rest on."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import dates as D
from corpusmill.functions import text as T
from corpusmill.operators import validity as V
from corpusmill.operators.overlap import best_overlaps
from corpusmill.plans.staging import BROADCAST_ROWS, cut, small_batches, small_or_shuffled, spread

# Bracket and citation grammar, least quote, drift.
BRACKET = r"\[(\d{1,2})\]"
CFR = rf"(?i)\b(\d{{1,2}})\s*(?:CFR|C\.F\.R\.)\s*§?\s*({T.CFR_SECTION}[a-z0-9()]*)"
USC = r"(?i)\b(\d{1,2})\s*U\.?S\.?C\.?\s*§?\s*(\d+[a-z0-9()\-]*)"
MIN_QUOTE, TITLE = 25, "8"


def brackets(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(BRACKET), 1), lambda x: x.cast("int")))


def out_of_range(answers: DataFrame) -> DataFrame:
    """(id, n) of source numbers cited beyond the sources given (id, text, n_sources)."""
    return answers.select("id", "n_sources", F.explode(brackets(F.col("text"))).alias("n")).where("n < 1 or n > n_sources").select("id", F.col("n").cast("long").alias("n"))


def cited_sections(text: Column) -> Column:
    """array<struct<title, corpus, section, raw>> of the citations a text makes."""

    def of(rx: str, corpus: str) -> Column:
        def one(x: Column) -> Column:
            sec = F.lower(F.regexp_extract(x, rx, 2))
            return F.struct(F.regexp_extract(x, rx, 1).alias("title"), F.lit(corpus).alias("corpus"), F.regexp_replace(sec, r"\(.*$", "").alias("section"), x.alias("raw"))

        return F.transform(F.regexp_extract_all(text, F.lit(rx), 0), one)

    return F.array_distinct(F.concat(of(CFR, "cfr"), of(USC, "usc")))


def bad_citations(answers: DataFrame, slate: DataFrame) -> DataFrame:
    """(id, raw, problem): a wrong title, or a section that no passage of the slate cites.

    Sections are compared as parsed citations, so 214.2 is not found in 214.20. The
    slate is (id, citation, text).
    """
    c = answers.select("id", F.explode(cited_sections(F.col("text"))).alias("c")).select("id", "c.*")
    cites = slate.select("id", V.parsed(F.col("citation")).alias("p")).where("p is not null").select("id", "p.corpus", F.lower("p.section").alias("section"))
    inside = slate.select("id", F.explode(cited_sections(F.col("text"))).alias("c")).select("id", "c.corpus", "c.section")
    known = cites.unionByName(inside).distinct().withColumn("known", F.lit(True))
    x = c.join(known, ["id", "corpus", "section"], "left")
    problem = F.when(F.col("title") != TITLE, "wrong title").when(F.col("known").isNull(), "in no source")
    return x.withColumn("problem", problem).where("problem is not null").select("id", "raw", "problem")


def ungrounded(answers: DataFrame) -> DataFrame:
    """(id, n, first): blocks that say what someone must or may do without a bracket."""
    x = answers.select("id", F.posexplode(T.blocks(F.col("text"))).alias("n", "block"))
    x = x.where(F.col("block").rlike(T.DEONTIC) & ~F.col("block").rlike(BRACKET))
    return x.groupBy("id").agg(F.count("*").alias("n"), F.substring(T.clean(F.min_by("block", "n")), 1, 90).alias("first"))


def too_many_questions(answers: DataFrame) -> DataFrame:
    x = answers.select("id", F.size(T.closing_questions(F.col("text"))).cast("long").alias("n"))
    return x.where("n > 1")


def reading(c: Column) -> Column:
    """A text as a reader sees it: entities decoded, white space collapsed."""
    decoded = F.when(c.contains("&"), T.unescape(c)).otherwise(c)  # most texts have no entity
    return T.clean(F.replace(decoded, F.lit(" "), F.lit(" ")))


def wanted(sentence: Column) -> Column:
    return F.regexp_replace(T.fold(reading(sentence)), r"^[ .;:]+|[ .;:]+$", "")


#: Words of a quoted sentence that make its join key.
KEY_WORDS = 4


def _standing(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, point, part, cited, want, source, clean, folded): every quote in sources that hold it, among
    them the first in order.

    Quotes that were counted to be few form an automaton, which passes once over each text;
    of the sources it finds, the first of each quote is read again for its wording. More
    quotes meet the sources by keys (``_standing_keyed``).
    """
    wants = cut(quotes.where("want is not null").select(F.col("want").alias("quote_id"), F.col("want").alias("quote")).distinct())
    if wants.limit(SHORT_BLOCK + 1).count() > SHORT_BLOCK:
        return _standing_keyed(quotes, sources)
    texts = sources.select(F.struct("id", "source").alias("source_id"), T.fold(reading(F.col("text"))).alias("text"))
    hits = short_in(wants, texts).select("source_id.id", "source_id.source", F.col("quote_id").alias("want"))
    hits = hits.join(small_or_shuffled(quotes), ["id", "want"])
    first = hits.groupBy("id", "point", "part").agg(F.min_by(F.struct("cited", "want", F.col("source").alias("_source")), _order()).alias("f"))
    first = cut(first.select("id", "point", "part", "f.*"))
    return _read_again(first, sources)


def _order() -> Column:
    """The cited source is tried first, then the others in order."""
    return F.struct((F.col("source") != F.col("cited")).cast("int"), "source")


def _read(rows: DataFrame) -> DataFrame:
    return rows.withColumn("clean", reading(F.col("text"))).withColumn("folded", T.fold(F.col("clean"))).drop("text")


def _read_again(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """The texts of ``pairs`` (id, _source, point, part, cited, want), where they hold what is wanted."""
    text = sources.select(F.col("id").alias("_id"), "source", "text")
    near = text.join(small_or_shuffled(pairs), (F.col("_id") == F.col("id")) & F.col("source").eqNullSafe(F.col("_source")))
    return _read(near).select("id", "point", "part", "cited", "want", "source", "clean", "folded").where(F.col("folded").contains(F.col("want")))


def _standing_keyed(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, point, part, cited, want, source, clean, folded): every quote in every source that holds it.

    The first and last word of a quote may be parts of longer words; those between them
    stand in a source word for word. Up to four of them are the key of an equi-join with
    the sources' word windows, and the pairs it finds are then checked exactly. Quotes of
    one or two words have no such key and are held against each source.
    """
    w = F.split("want", " ")
    n = F.greatest(F.least(F.size(w) - 2, F.lit(KEY_WORDS)), F.lit(0))
    quotes = quotes.withColumn("n", n).withColumn("key", F.array_join(F.slice(w, F.lit(2), n), " "))
    sizes = [r.n for r in quotes.select("n").distinct().collect()]  # five at most

    def windows(w: Column, k: int) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k))
        return F.coalesce(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])), F.array().cast("array<string>"))

    columns = ["id", "point", "part", "cited", "want", "source", "clean", "folded"]
    found = _read(quotes.where("n = 0").join(sources, "id")).select(columns).where(F.col("folded").contains(F.col("want"))) if 0 in sizes else None
    if keyed := [k for k in sizes if k]:
        # the words are bound by a lambda, so that a text is read and split once and not for every window
        keys = F.transform(F.array(F.split("folded", " ")), lambda w: F.concat(*[windows(w, k) for k in keyed]))
        # a plain explode would make the keys twice, the first time to look for empty arrays
        grams = _read(sources).select("id", "source", F.explode_outer(F.flatten(keys)).alias("key"))
        pairs = cut(grams.join(small_or_shuffled(quotes.where("n > 0")), ["id", "key"]).select("id", F.col("source").alias("_source"), "point", "part", "cited", "want").distinct())
        near = _read_again(pairs, sources)
        found = near if found is None else near.unionByName(found)
    if found is None:
        found = _read(quotes.join(sources, "id")).select(columns).where(F.col("folded").contains(F.col("want")))
    return found


def containing(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (quote_id, source_id) of the ``quotes`` (quote_id, quote) that stand whole in ``sources`` (source_id, text).

    The first and last word of a quote may be parts of longer ones; up to four words
    between them are its key, as a hash. A source keeps only the hashes of its word windows
    that are keys, in its own row; the pairs that this gives are confirmed on the texts of
    the sources that are left. Quotes of one or two words have no such key; they are found
    by ``short_in``. Null quotes and texts stand nowhere; ids may be null or repeat.
    """
    w = T.words(F.col("quote"))
    n = F.greatest(F.least(F.size(w) - 2, F.lit(KEY_WORDS)), F.lit(0))
    q = cut(quotes.where("quote is not null").select("quote_id", "quote", n.alias("n"), F.xxhash64(n, F.array_join(F.slice(w, F.lit(2), n), " ")).alias("key")))
    sizes = [r.n for r in q.select("n").distinct().collect()]  # five at most
    found = short_in(q.where("n = 0"), sources) if 0 in sizes else None

    if any(sizes):
        # a row number names the source, whose id need not
        s = sources.where("text is not null").select("source_id", "text", F.xxhash64("source_id", "text").alias("row"))
        at = s.select("row", T.words(F.col("text")).alias("w0"))
        for k in range(1, max(sizes)):
            at = at.withColumn(f"w{k}", F.slice("w0", k + 1, 1 << 30))
        at = at.select("row", F.explode(F.arrays_zip(*[f"w{k}" for k in range(max(sizes))])).alias("z"))
        # a word and those after it; at the end of a text fewer
        window = lambda k: F.when(F.col(f"z.w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), F.concat_ws(" ", *[f"z.w{j}" for j in range(k)])))
        hashes = [window(k) for k in sizes if k]
        grams = at.select("row", hashes[0].alias("key") if len(hashes) == 1 else F.explode(F.array(*hashes)).alias("key"))
        pairs = cut(grams.join(small_or_shuffled(q.where("n > 0").select("key").distinct()), "key").distinct())
        near = s.join(small_or_shuffled(pairs.select("row").distinct()), "row").dropDuplicates(["row"])
        keyed = near.join(pairs, "row").join(small_or_shuffled(q.where("n > 0")), "key").where(F.col("text").contains(F.col("quote")))
        keyed = keyed.select("quote_id", "source_id")
        found = keyed if found is None else found.unionByName(keyed)
    if found is None:  # no quotes
        found = q.join(sources, F.lit(False)).select("quote_id", "source_id")
    return found.distinct()


#: Quotes that one automaton holds.
SHORT_BLOCK = 50_000


def short_in(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote_id, source_id) of quotes (quote_id, quote) that stand in sources (source_id, text), however short.

    All quotes of a block form one automaton, which finds them in a single pass over a
    text; no text is held against quotes one by one. A block is what a task can hold:
    more quotes are more passes. An empty quote stands in every text.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = quotes.where("quote is not null").select("quote_id", "quote").distinct()
    blocks = max(1, -(-rows.count() // SHORT_BLOCK))
    kinds = [to_arrow_type(quotes.schema["quote_id"].dataType), to_arrow_type(sources.schema["source_id"].dataType)]
    schema = f"quote_id {dict(quotes.dtypes)['quote_id']}, source_id {dict(sources.dtypes)['source_id']}"

    def search(held: dict[str, list]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            every, automaton = held.get("", []), ahocorasick.Automaton()
            for quote in held:
                if quote:
                    automaton.add_word(quote, quote)
            automaton.make_automaton()
            for b in batches:
                found: list[tuple] = []
                for source, text in zip(b.column("source_id").to_pylist(), b.column("text")):
                    if text.is_valid:
                        hits = {q for _, q in automaton.iter(text.as_py())} if len(automaton) else ()
                        found += [(i, source) for i in every] + [(i, source) for q in hits for i in held[q]]
                columns = list(zip(*found)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["quote_id", "source_id"])

        return run

    small_batches(sources.sparkSession)
    texts, out = spread(sources.select("source_id", "text")), None
    for n in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("quote_id", "quote"), F.lit(blocks)) == n) if blocks > 1 else rows
        held: dict[str, list] = {}
        for r in part.collect():
            held.setdefault(r.quote, []).append(r.quote_id)
        x = texts.mapInArrow(search(held), schema)
        out = x if out is None else out.unionByName(x)
    return out


def check_quotes(points: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, point, part, cited, source, quote, applies, moved, kept) of each sentence quoted.

    ``points`` is (id, point, cited, quote, applies), ``sources`` (id, source, text). A
    sentence of 25 characters or more must stand in a source; the cited one is tried
    first, then the others in order; the source's own wording is what is returned.
    """
    s = points.select("id", "point", "cited", "applies", F.posexplode(F.when(F.size(T.sentences(F.col("quote"), T.QUOTE_SENTENCE)) > 0, T.sentences(F.col("quote"), T.QUOTE_SENTENCE)).otherwise(F.array("quote"))).alias("part", "sentence"))
    s = s.withColumn("want", wanted(F.col("sentence")))
    hit = _standing(s.where(F.length("want") >= MIN_QUOTE).select("id", "point", "part", "cited", "want"), sources.select("id", "source", "text"))
    own = F.substring("clean", F.expr("locate(want, folded)"), F.length("want"))
    best = hit.groupBy("id", "point", "part").agg(F.min_by(F.struct("source", own.alias("quote")), _order()).alias("b"))
    x = s.join(best, ["id", "point", "part"], "left")
    return x.select("id", "point", "part", "cited", F.col("b.source").alias("source"), F.coalesce("b.quote", "sentence").alias("quote"), F.when(F.col("part") == 0, F.col("applies")).otherwise("").alias("applies"), F.coalesce(F.col("b.source") != F.col("cited"), F.lit(False)).alias("moved"), F.col("b").isNotNull().alias("kept"))


POINTS = "answer string, points array<struct<source:int,quote:string,applies:string>>, ask string"


def quote_points(raw: DataFrame) -> DataFrame:
    """(id, point, cited, quote, applies) from JSON replies (id, raw); unreadable ones give none."""
    x = raw.select("id", F.from_json("raw", POINTS).alias("j")).select("id", F.posexplode("j.points").alias("point", "p"))
    return x.select("id", "point", F.coalesce("p.source", F.lit(0)).alias("cited"), F.coalesce("p.quote", F.lit("")).alias("quote"), F.coalesce("p.applies", F.lit("")).alias("applies"))


def answer_text(raw: Column) -> Column:
    """The JSON reply's answer, or the reply itself where it is prose."""
    return F.coalesce(F.nullif(F.trim(F.get_json_object(raw, "$.answer")), F.lit("")), raw)


def attributions(raw: DataFrame) -> DataFrame:
    """(id, claim, source) from JSON replies (id, raw, n_claims, n_sources).

    Malformed replies give nothing; a claim out of range, or not an integer, drops; a
    source out of range is null; the first answer for a claim wins.
    """
    items = F.from_json(F.get_json_object("raw", "$.attributions"), "array<map<string,string>>")
    x = raw.where(F.get_json_object("raw", "$.attributions").startswith("[")).select("id", "n_claims", "n_sources", F.posexplode(items).alias("n", "m"))
    has = F.map_contains_key("m", "claim") & F.map_contains_key("m", "source")
    whole = lambda k: F.when(F.element_at("m", F.lit(k)).rlike(r"^-?\d+$"), F.element_at("m", F.lit(k)).try_cast("long"))
    x = x.where(has).select("id", "n", "n_claims", "n_sources", whole("claim").alias("claim"), whole("source").alias("s"))
    x = x.where("claim is not null and claim >= 0 and claim < n_claims")
    first = x.groupBy("id", "claim").agg(F.min_by(F.struct("s", "n_sources"), "n").alias("f"))
    return first.select("id", "claim", F.when(F.col("f.s").between(1, F.col("f.n_sources")), F.col("f.s")).alias("source"))


def check_dates(answers: DataFrame, slate: DataFrame, boundaries: DataFrame, settled: str = "settled") -> DataFrame:
    """(id, raw, d, verdict, boundary): each date an answer states, block by block.

    ``slate`` is (id, source, served) with '' for suspended passages, ``boundaries``
    (id, ord, name, d) the computed window ends. A boundary is right; then support by
    the cited sources (all, if the block cites none usable) or the settled text; then
    drift of 1-3 days from the first such boundary; else the date was derived.
    """
    b = answers.select("id", settled, F.posexplode(F.when(F.size(T.blocks(F.col("text"))) > 0, T.blocks(F.col("text"))).otherwise(F.array("text"))).alias("block_no", "block"))
    x = b.select("id", settled, "block_no", brackets(F.col("block")).alias("cited"), F.explode(F.array_distinct(D.dates_in(F.col("block")))).alias("x")).select("id", settled, "block_no", "cited", "x.raw", "x.d")
    key = ["id", "block_no", "raw", "d"]
    usable = slate.where("served != ''").select("id", "source", "served")
    s = x.join(usable, "id", "left").withColumn("is_cited", F.array_contains("cited", F.col("source"))).withColumn("says", D.supported(F.col("d"), F.coalesce("served", F.lit(""))))
    s = s.groupBy(*key, settled).agg(F.coalesce(F.bool_or("is_cited"), F.lit(False)).alias("any_cited"), F.coalesce(F.bool_or(F.col("is_cited") & F.col("says")), F.lit(False)).alias("by_cited"), F.coalesce(F.bool_or("says"), F.lit(False)).alias("by_any"))
    ok = F.when(F.col("any_cited"), F.col("by_cited")).otherwise(F.col("by_any")) | D.supported(F.col("d"), F.coalesce(settled, F.lit("")))
    s = s.withColumn("ok", ok)
    near = s.join(boundaries.select(F.col("id").alias("bid"), "ord", "name", F.col("d").alias("bd")), (F.col("id") == F.col("bid")) & F.abs(F.datediff("d", "bd")).between(0, D.DRIFT), "left")
    g = near.groupBy(*key, "ok").agg(F.coalesce(F.bool_or(F.col("bd") == F.col("d")), F.lit(False)).alias("exact"), F.min_by(F.struct("name", "bd"), "ord").alias("n"))
    verdict = F.when(F.col("exact"), "boundary").when(F.col("ok"), "supported").when(F.col("n").isNotNull(), "drift").otherwise("derived")
    return g.select("id", "raw", "d", verdict.alias("verdict"), F.when(verdict == "drift", F.col("n.bd")).alias("boundary")).distinct()


def absent_quotes(quotes: DataFrame, served: DataFrame) -> DataFrame:
    """Quotes (citation, quote) that no served passage under their citation holds: none expected."""
    q, p = quotes.alias("q"), served.alias("p")
    return q.join(p, (F.col("q.citation") == F.col("p.citation")) & T.clean(F.col("p.text")).contains(F.col("q.quote")), "left_anti")


def sequence_breaks(paragraphs: DataFrame) -> DataFrame:
    """Lettered paragraphs (section, ord, letter) that do not follow their predecessor."""
    w = Window.partitionBy("section").orderBy("ord")
    before = F.coalesce(F.lag("letter").over(w), F.lit(""))
    return paragraphs.withColumn("before", before).where(~T.next_letter(F.col("before"), F.col("letter"))).select("section", "ord", "before", "letter")


def unkept_promises(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (section, ord, text) that promise a list with nothing after them."""
    w = Window.partitionBy("section").orderBy("ord")
    return paragraphs.withColumn("next", F.lead("text").over(w)).where(T.promises_list(F.col("text")) & F.col("next").isNull()).select("section", "ord")


def support(claims: DataFrame, sources: DataFrame, least: float = 0.6) -> DataFrame:
    """(claim, ratio, flagged): the greatest share of a claim's words in one source sentence."""
    c = claims.select("claim", T.content_words(F.col("text")).alias("cw"))
    s = sources.select("claim", F.explode(T.sentences(F.col("text"))).alias("s")).select("claim", T.content_words(F.col("s")).alias("sw"))
    x = c.join(s, "claim", "left").groupBy("claim", "cw").agg(F.max(F.size(F.array_intersect("cw", F.coalesce("sw", F.array().cast("array<string>"))))).alias("n"))
    ratio = F.when(F.size("cw") == 0, F.lit(1.0)).otherwise(F.coalesce("n", F.lit(0)) / F.size("cw"))
    return x.select("claim", ratio.alias("ratio"), (ratio < least).alias("flagged"))


class BestOverlap:
    """The largest overlap of each claim's words with any set of words met so far.

    A claim's words stand rarest first. A set that shares more words than the best so far
    misses fewer than the rest, so it holds one of the first ``size - best`` words: only
    those lead from a word to a claim, fewer and fewer as the best grows, and none once a
    whole claim was met. Sets with no more of the claims' words than the best are skipped.
    """

    def __init__(self, claims: list[set[str]], frequency: dict[str, int]):
        self.claims, self.best, self.compared = claims, [0] * len(claims), 0
        ranked = [sorted(c, key=lambda w: (frequency.get(w, 0), w)) for c in claims]
        self.leads: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(ranked):
            for rank, w in enumerate(words):
                self.leads.setdefault(w, []).append((k, rank))

    def meet(self, words: set[str]) -> None:
        known = words & self.leads.keys()
        near = {k for w in known for k, rank in self.leads[w] if rank < len(self.claims[k]) - self.best[k]}
        for k in near:
            if len(words) > self.best[k]:
                self.compared += 1
                self.best[k] = max(self.best[k], len(self.claims[k] & words))

    def prune(self) -> None:
        """Forget what no longer leads to a claim."""
        for w in list(self.leads):
            self.leads[w] = [(k, rank) for k, rank in self.leads[w] if rank < len(self.claims[k]) - self.best[k]]
            if not self.leads[w]:
                del self.leads[w]


def sentence_words(text: str) -> Iterator[set[str]]:
    """The content words of each sentence, as ``T.sentences`` and ``T.content_words`` have them."""
    for s in re.split(T.SENTENCE, text.strip(" "), flags=re.ASCII):
        yield {w for w in re.findall("[a-z]+", s.lower()) if len(w) > 2 and w not in T.STOP}


#: Claims up to which every task holds all of them.
FEW_CLAIMS = 2_000


def support_in_any(claims: DataFrame, sources: DataFrame, least: float = 0.6) -> DataFrame:
    """(claim, ratio, flagged) as ``support`` has it, over the sentences of all sources (text).

    Claims that were counted to be few go to every task, which walks over its sentences with
    ``BestOverlap`` (words ranked by their frequency in the task's first batch of texts) and
    gives one row a claim. More claims meet the sentences in blocks (``overlap.best_overlaps``).
    Null texts say nothing; a claim without content words is supported; repeated claims
    count once each.
    """
    c = cut(claims.select("claim", T.content_words(F.coalesce("text", F.lit(""))).alias("cw"), F.monotonically_increasing_id().alias("n")))
    most = min(FEW_CLAIMS, BROADCAST_ROWS)
    held = c.select("n", "cw").limit(most + 1).collect()
    if len(held) > most:
        met = best_overlaps(c, sources, sentence_words).groupBy("n").agg(F.max("shared").alias("shared"))
        return _ratios(c.join(cut(met), "n", "left"), least)
    numbers, words = [r.n for r in held], [set(r.cw) for r in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overlap = None
        for b in batches:
            texts = [x for x in b.column("text").to_pylist() if x is not None]
            if overlap is None:
                seen = Counter(w for t in texts for s in sentence_words(t) for w in s)
                overlap = BestOverlap(words, seen)
            for t in texts:
                for s in sentence_words(t):
                    overlap.meet(s)
            overlap.prune()
        best = overlap.best if overlap else []
        yield pa.RecordBatch.from_arrays([pa.array(numbers[: len(best)], pa.int64()), pa.array(best, pa.int32())], names=["n", "shared"])

    small_batches(sources.sparkSession, 1 << 20)
    most = spread(sources.select("text")).mapInArrow(run, "n long, shared int").groupBy("n").agg(F.max("shared").alias("shared"))
    return _ratios(c.join(small_or_shuffled(cut(most)), "n", "left"), least)


def _ratios(x: DataFrame, least: float) -> DataFrame:
    ratio = F.when(F.size("cw") == 0, F.lit(1.0)).otherwise(F.coalesce("shared", F.lit(0)) / F.size("cw"))
    return x.select("claim", ratio.alias("ratio"), (ratio < least).alias("flagged"))


def best_sources(claims: DataFrame, sources: DataFrame, n: int = 3) -> DataFrame:
    """The n sources of each claim with the most words in common."""
    x = claims.select("claim", T.content_words(F.col("text")).alias("cw")).join(sources.select("claim", "source", T.content_words(F.col("text")).alias("sw")), "claim")
    x = x.select("claim", "source", F.size(F.array_intersect("cw", "sw")).cast("long").alias("shared"))
    w = Window.partitionBy("claim").orderBy(F.col("shared").desc(), "source")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
