"""A stored inverted index that grows by segments and is searched by block maxima.

A segment is what one ``add`` wrote: its documents with their counted terms, its term
statistics and its postings. Documents that stand together are a block, whose number they
bear; a posting row is a (term, block) with all its entries and two bounds, the largest term
frequency and the smallest document length. From those follows the most that any document
of the block can score for the term, whatever the average length has become. Posting
rows are made where the documents are read and sorted by term and block within their file, so
nothing is shuffled, a hot term is in all files, a document's terms in one, and a search for
few terms skips most of each.

An ``add`` replaces documents of the same id, a ``remove`` takes them out: both leave old
segments as they are and write tombstones, one row a block with the ids that are gone, and
the changes of document frequency and length that they cause. What is gone is found by ids
and lengths alone and taken out where the block is read: neither texts nor terms nor
postings are shuffled for it. The statistics of a search are sums over segments and such
changes. Segments of one order of size are merged once there are ``FAN`` of them, from
their counted terms; texts are not needed again.

The state of a store is its latest manifest, a small table of a version; a version that was
not written to its end is never read. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from corpusmill.functions import text as T
from corpusmill.functions.process_cache import frugal
from corpusmill.operators import retrieve
from corpusmill.operators.index import FEW_TERMS, queries_to_terms
from corpusmill.plans.staging import BROADCAST_ROWS, cut, small_or_shuffled, spread, work_folder

K1, B = 1.5, 0.75
#: Documents of a block, blocks scored before the threshold is known, and segments of a tier before they merge.
BLOCK_DOCS, FIRST_BLOCKS, FAN = 128, 8, 4
#: A block is dropped only if its bound is below the threshold by more than sums may be off.
SLACK = 1e-9
#: Blocks whose tombstones are broadcast, once they were counted to be no more.
DEAD_BLOCKS = BROADCAST_ROWS // 4

DOCUMENTS = "block long, id {0}, len long, terms array<struct<term:string,tf:long>>"
POSTINGS = "term string, block long, max_tf long, min_len long, entries array<struct<id:{0},tf:long,len:long>>"
MANIFEST = "segment string, n long, tombstones string"


def impact(tf: Column, length: Column, avglen: Column) -> Column:
    """What one term adds to a score, before its weight: it rises with tf and falls with length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avglen))


def _posted(id_type: DataType):
    """Posting rows of documents (block, id, len, terms), block by block, in the task that reads them.

    A block that batches or tasks cut in two has two rows a term, which bound it as well."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            of = whole.column("block").to_numpy()
            new = np.flatnonzero(np.append(True, np.diff(of))) if len(of) else []
            for lo, hi in zip(new, [*new[1:], len(of)]):
                b, block = whole.slice(lo, hi - lo), of[lo]
                terms, ids, lens = b.column("terms"), b.column("id"), b.column("len").to_numpy()
                flat = terms.flatten()
                if not len(flat):
                    continue
                owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
                coded = flat.field("term").dictionary_encode()
                codes = coded.indices.to_numpy()
                order = np.lexsort((owner, codes))
                first = np.flatnonzero(np.append(True, np.diff(codes[order])))
                owner, tf = owner[order], flat.field("tf").to_numpy()[order]
                entries = pa.StructArray.from_arrays([ids.take(pa.array(owner)).cast(kind), pa.array(tf), pa.array(lens[owner])], names=["id", "tf", "len"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), entries)
                columns = [coded.dictionary.take(pa.array(codes[order][first])), pa.array(np.full(len(first), block, np.int64)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(lens[owner], first)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "block", "max_tf", "min_len", "entries"])

    return run


@dataclass
class Store:
    """``id_type`` is the type of the documents' ids: long or string."""

    spark: SparkSession
    root: str
    id_type: str = "long"

    # --- state -------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        """Versions whose manifests were written to their end."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(fs_path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def manifest(self) -> list[dict]:
        """(segment, n, tombstones) of the current version; a segment has one row, each batch of tombstones one more."""
        versions = self._versions()
        if not versions:
            return []
        return [r.asDict() for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{versions[-1]}").collect()]

    def _commit(self, rows: list[dict]) -> None:
        version = max(self._versions(), default=0) + 1
        self.spark.createDataFrame([(r["segment"], r["n"], r["tombstones"]) for r in rows], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/{version}")

    def _read(self, kind: str, schema: str, names: list[str]) -> DataFrame:
        paths = [f"{self.root}/{kind}/{n}" for n in names]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        out = None
        for n, p in zip(names, paths):
            x = self.spark.read.schema(schema).parquet(p).withColumn("segment", F.lit(n))
            out = x if out is None else out.unionByName(x)
        return out

    def segments(self) -> list[str]:
        return [r["segment"] for r in self.manifest() if r["segment"]]

    def _gone(self, rows: list[dict]) -> list[str]:
        return [r["tombstones"] for r in rows if r["tombstones"]]

    def _counted(self, names: list[str]) -> DataFrame:
        """(segment, block, id, len, terms) of segments as they were written."""
        return self._read("documents", DOCUMENTS.format(self.id_type), names)

    def documents(self, rows: list[dict] | None = None) -> DataFrame:
        """(segment, block, id, len, terms) of all documents that are still there."""
        rows = self.manifest() if rows is None else rows
        d = self._counted([r["segment"] for r in rows if r["segment"]])
        if not self._gone(rows):
            return d
        d = d.join(small_or_shuffled(cut(self._dead(rows)), DEAD_BLOCKS), ["segment", "block"], "left")
        return d.where("dead is null or not array_contains(dead, id)").drop("dead")

    def _dead(self, rows: list[dict]) -> DataFrame:
        """(segment, block, dead): the ids that are gone, one row a block."""
        t = self._read("tombstones", f"of string, block long, dead array<{self.id_type}>", self._gone(rows))
        return t.groupBy(F.col("of").alias("segment"), "block").agg(F.flatten(F.collect_list("dead")).alias("dead"))

    # --- writing -----------------------------------------------------------------------

    def _write_segment(self, counted: DataFrame) -> dict:
        """``counted`` (id, len, terms), one row an id, as a new segment."""
        name = uuid.uuid4().hex
        place = F.expr(f"monotonically_increasing_id() div {BLOCK_DOCS}")
        counted.select(place.alias("block"), "id", "len", "terms").write.parquet(f"{self.root}/documents/{name}")
        d = self._counted([name])
        n = d.count()
        rows = d.select("block", "id", "len", "terms").mapInArrow(frugal(_posted(d.schema["id"].dataType)), POSTINGS.format(self.id_type))
        rows.sortWithinPartitions("term", "block").write.parquet(f"{self.root}/postings/{name}")
        d.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{self.root}/terms/{name}")
        return {"segment": name, "n": n, "tombstones": None}

    def _bury(self, rows: list[dict], ids: DataFrame) -> list[dict]:
        """Tombstones of the stored documents with one of ``ids`` (id), with their terms' and lengths' counts."""
        if not rows:
            return []
        placed = self.documents(rows).select("segment", "block", "id", "len")
        return self._entomb(rows, placed.join(small_or_shuffled(cut(ids.select("id").distinct())), "id", "left_semi"))

    def _entomb(self, rows: list[dict], doomed: DataFrame) -> list[dict]:
        """Tombstones of ``doomed`` (segment, block, id, len); their terms are counted where they stand."""
        old = cut(doomed.groupBy("segment", "block").agg(F.collect_list("id").alias("dead"), F.count("*").alias("n"), F.sum("len").alias("len")))
        if old.isEmpty():
            return []
        name = uuid.uuid4().hex
        old.select(F.col("segment").alias("of"), "block", "dead").write.parquet(f"{self.root}/tombstones/{name}")
        held = self._counted([r["segment"] for r in rows if r["segment"]]).select("segment", "block", "id", "terms")
        held = held.join(small_or_shuffled(old.select("segment", "block", "dead"), DEAD_BLOCKS), ["segment", "block"]).where("array_contains(dead, id)")
        held.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{self.root}/fewer_terms/{name}")
        sums = old.agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
        sums.write.parquet(f"{self.root}/fewer_docs/{name}")
        return [{"segment": None, "n": sums.first().n, "tombstones": name}]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Documents (id, text) as a new segment; stored ones of the same id are replaced.

        Of rows with one id the longest text (then the last in order) stands for it; rows
        without an id are not stored; a null text is an empty document.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(self.id_type).alias("id"), text.alias("text"))
        counted = spread(_one_an_id(rows)).select("id", T.counted_terms(F.col("text")).alias("terms"))
        size = F.aggregate("terms", F.lit(0).cast("long"), lambda s, x: s + x["tf"])
        made = self._write_segment(counted.select("id", F.greatest(size, F.lit(1).cast("long")).alias("len"), "terms"))
        rows = self.manifest()
        new = self.spark.read.schema(f"id {self.id_type}").parquet(f"{self.root}/documents/{made['segment']}")
        self._commit([*rows, *self._bury(rows, new), made])
        self._merge_tiers()

    def remove(self, ids: DataFrame) -> None:
        """The documents of ``ids`` (id) out of the index; their segments stay as they are."""
        rows = self.manifest()
        if buried := self._bury(rows, ids):
            self._commit([*rows, *buried])

    def _merge_tiers(self) -> None:
        """Merge the segments of a tier (a power of FAN in size) once there are FAN of them."""
        while True:
            tiers: dict[int, list[str]] = {}
            for r in self.manifest():
                if r["segment"]:
                    tiers.setdefault(len(f"{max(r['n'], 1):b}") * 2 // FAN, []).append(r["segment"])
            full = next((s for s in tiers.values() if len(s) >= FAN), None)
            if full is None:
                return
            self.merge(full)

    def merge(self, names: list[str] | None = None) -> None:
        """The segments ``names`` (all) as one, without what was removed from them."""
        rows = self.manifest()
        names = [r["segment"] for r in rows if r["segment"]] if names is None else names
        live = self.documents(rows).where(F.col("segment").isin(names)).select("id", "len", "terms")
        made = self._write_segment(live)
        kept = [r for r in rows if r["segment"] and r["segment"] not in names]
        # tombstones of merged segments are done with; the others' counts are written anew
        buried = []
        if kept and self._gone(rows):
            rest = cut(self._dead(rows).where(~F.col("segment").isin(names)))
            d = self._counted([r["segment"] for r in kept]).select("segment", "block", "id", "len")
            buried = self._entomb(kept, d.join(small_or_shuffled(rest, DEAD_BLOCKS), ["segment", "block"]).where("array_contains(dead, id)"))
        self._commit([*kept, *buried, made])

    # --- searching ---------------------------------------------------------------------

    def statistics(self, rows: list[dict] | None = None) -> DataFrame:
        """One row: n (at least 1) and avglen (1.0 if empty) of the documents that are there."""
        rows = self.manifest() if rows is None else rows
        d = self._read("documents", f"id {self.id_type}, len long", [r["segment"] for r in rows if r["segment"]]).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
        if self._gone(rows):
            less = self._read("fewer_docs", "n long, len long", self._gone(rows)).select((-F.col("n")).alias("n"), (-F.col("len")).alias("len"))
            d = d.unionByName(less).agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
        return d.select(F.greatest("n", F.lit(1)).cast("long").alias("n"), F.when(F.col("n") > 0, F.col("len") / F.col("n")).otherwise(1.0).alias("avglen"))

    def frequencies(self, rows: list[dict] | None = None, of: DataFrame | None = None) -> DataFrame:
        """(term, df) over the documents that are there, of all terms or those of ``of`` (term)."""
        rows = self.manifest() if rows is None else rows
        t = self._read("terms", "term string, df long", [r["segment"] for r in rows if r["segment"]]).select("term", "df")
        if self._gone(rows):
            t = t.unionByName(self._read("fewer_terms", "term string, df long", self._gone(rows)).select("term", (-F.col("df")).alias("df")))
        t = t if of is None else t.join(small_or_shuffled(of), "term", "left_semi")
        return t.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _postings(self, rows: list[dict], terms: list[str] | None, columns: str) -> DataFrame:
        p = self._read("postings", columns, [r["segment"] for r in rows if r["segment"]])
        if terms is None:
            return p
        one = F.lit(False)
        for t in terms:
            one = one | (F.col("term") == t)
        return p.where(one)

    def search(self, queries: DataFrame, n: int, digits: int | None = 9, blocks: list[DataFrame] | None = None) -> DataFrame:
        """(q, id, bm25, rank): the n best documents of every query (q, text), by score (to ``digits`` decimals) and id.

        Blocks are bounded by the sum of their terms' bounds. The blocks of the highest
        bounds are scored first; the n-th best score then is a threshold, and only blocks
        whose bound reaches it are scored, too. No document of another block can be among the n best.
        ``blocks`` takes the frames (q, segment, block) of what was scored.
        """
        terms, rows = queries_to_terms(queries), self.manifest()
        few = [r.term for r in terms.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        few = few if len(few) <= FEW_TERMS else None
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        # corpus statistics are one row by construction
        weights = cut(terms.join(self.frequencies(rows, cut(terms.select("term").distinct())), "term").crossJoin(F.broadcast(self.statistics(rows))).select("q", "term", idf.alias("idf"), "avglen"))
        wanted = small_or_shuffled(weights)
        bound = F.col("idf") * impact(F.col("max_tf"), F.col("min_len"), F.col("avglen"))
        heads = cut(self._postings(rows, few, "term string, block long, max_tf long, min_len long").join(wanted, "term").groupBy("q", "segment", "block").agg(F.sum(bound).alias("bound")))
        ranked = cut(retrieve.top(heads.withColumn("key", F.xxhash64("segment", "block")), "bound", FIRST_BLOCKS, "key").select("q", "segment", "block"))
        first = cut(self._scored(rows, ranked, wanted, few))
        by = F.col("bm25") if digits is None else F.round("bm25", digits)
        best = retrieve.top(first.withColumn("by", by), "by", n)
        threshold = best.where(F.col("rank") == n).select("q", F.col("by").alias("least"))
        rest = heads.join(ranked, ["q", "segment", "block"], "left_anti").join(small_or_shuffled(threshold), "q", "left")
        rest = rest.where(F.col("least").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("least")))
        rest = cut(rest.select("q", "segment", "block"))
        if blocks is not None:
            blocks += [ranked.select("q", "segment", "block"), rest]
        both = first if rest.isEmpty() else first.unionByName(self._scored(rows, rest, wanted, few))
        return retrieve.top(both.withColumn("by", by), "by", n).drop("by")

    def _scored(self, rows: list[dict], blocks: DataFrame, wanted: DataFrame, few: list[str] | None) -> DataFrame:
        """(q, id, bm25) of every document with a term of the query in the ``blocks`` (q, segment, block)."""
        p = self._postings(rows, few, f"term string, block long, entries array<struct<id:{self.id_type},tf:long,len:long>>")
        # one row a term and one a block: postings stay in their tasks, which hold all terms of a document
        per_term = wanted.groupBy("term").agg(F.collect_list(F.struct("q", "idf")).alias("asked"), F.first("avglen").alias("avglen"))
        per_block = blocks.groupBy("segment", "block").agg(F.collect_set("q").alias("qs"))
        per_block = cut(per_block.join(self._dead(rows), ["segment", "block"], "left") if self._gone(rows) else per_block.withColumn("dead", F.lit(None).cast(f"array<{self.id_type}>")))
        x = p.join(small_or_shuffled(cut(per_term)), "term").join(small_or_shuffled(per_block), ["segment", "block"])
        x = x.withColumn("asked", F.filter("asked", lambda a: F.array_contains("qs", a["q"]))).where(F.size("asked") > 0)
        x = x.select("dead", "avglen", "asked", F.inline("entries")).where("dead is null or not array_contains(dead, id)").select("avglen", "id", "tf", "len", F.inline("asked"))
        return x.groupBy("q", "id").agg(F.sum(F.col("idf") * impact(F.col("tf"), F.col("len"), F.col("avglen"))).alias("bm25"))

    def shares(self, queries: DataFrame, n: int) -> tuple[int, int]:
        """(entries of the blocks that a search for ``queries`` scores, entries of all its terms' postings)."""
        blocks: list[DataFrame] = []
        self.search(queries, n, blocks=blocks).count()
        terms = queries_to_terms(queries)
        p = self._read("postings", f"term string, block long, entries array<struct<id:{self.id_type}>>", self.segments())
        size = lambda df: df.agg(F.sum(F.size("entries"))).first()[0] or 0
        return sum(size(p.join(terms.join(b, "q"), ["segment", "term", "block"])) for b in blocks), size(p.join(terms, "term"))


def _one_an_id(docs: DataFrame) -> DataFrame:
    """Of rows (id, text) with one id the longest text (then the last in order). Ids are counted alone; only
    texts whose ids repeat are gathered, where those ids were counted to be few."""
    longest = lambda x: x.groupBy("id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    twice = cut(docs.groupBy("id").count().where("count > 1").select("id"))
    n = twice.limit(BROADCAST_ROWS + 1).count()
    if n == 0:
        return docs
    if n > BROADCAST_ROWS:
        return longest(docs)
    return docs.join(F.broadcast(twice), "id", "left_anti").unionByName(longest(docs.join(F.broadcast(twice), "id", "left_semi")))


_kept: dict[tuple, Store] = {}


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """The session's store of a table of files, built when it is first asked for and again when its files change."""
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, *state, id_col, text_col)
    if key not in _kept:
        store = Store(spark, work_folder(spark, "store"))
        store.add(docs, id_col, text_col)
        _kept[key] = store
    return _kept[key]
