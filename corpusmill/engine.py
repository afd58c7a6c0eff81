"""One entry for users: build shards, search them, and answer with rules and checks.

The stages are the operators of this package in one order for every caller:
context, scope, rewriting, retrieval, gate, rules, prompt. The checks of an answer
are selectable. Text generation stays outside; it is a function the caller gives.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import answering, conversation, embed, index, ingest, retrieve, terminology, validity
from corpusmill.plans.staging import cut, small_or_shuffled
from corpusmill.sources import landing, registry, shards


@dataclass
class Engine:
    spark: SparkSession
    root: str
    client: embed.Client = field(default_factory=embed.hashing)
    model: str = "hashing-64"
    register: DataFrame | None = None

    # --- building ------------------------------------------------------------------

    def build(self, files: DataFrame, slug: str, chunker: str, **options) -> dict:
        """Chunk, embed and store one source; a failure is reported, not raised."""
        try:
            p = ingest.passages(ingest.units(files, chunker), slug, **options)
            stored = p.join(embed.vectors(p, self.client), "id")
            shards.write(stored, self.root)
            n = self.passages().where(F.col("shard") == slug).count()
            return {"slug": slug, "chunks": n, "problem": None if n else "no passages"}
        except Exception as e:
            return {"slug": slug, "chunks": 0, "problem": f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"}

    def passages(self, private: bool = True) -> DataFrame:
        p = shards.read(self.spark, self.root)
        return p if private else p.where("tier != 9")

    def init(self, definitions: DataFrame, landed: DataFrame, shipped: DataFrame | None = None) -> list[dict]:
        """Build every defined source from its landed files (source, path, content), or from the
        ``shipped`` ones where nothing was fetched. One report a definition."""
        files = landed if shipped is None else landing.first_available(landed, shipped, "source")
        out = []
        for d in definitions.collect():  # the definitions are files that a person wrote
            own = files.where(F.col("source") == d.slug)
            own = own.select("path", "content") if d.chunker in ("regulation", "pdf") else own.select("path", F.col("content").cast("string").alias("text"))
            if d.chunker == "manual":
                own = own.select(F.xxhash64("path").alias("page_id"), F.col("text").alias("html"))
            out.append(self.build(own, d.slug, d.chunker, tier=d.tier, kind=d.kind, url=d.url, source_title=d.title))
        return out

    def add(self, files: DataFrame) -> dict:
        """Private documents (path, text) of accepted kinds, kept and built as shard ``me`` of tier 9.

        A document of the same name replaces the one kept; others stay.
        """
        ok = files.where(landing.accepted_suffix(F.col("path")))
        refused = [r.path for r in files.where(~landing.accepted_suffix(F.col("path"))).select("path").limit(100).collect()]
        name = F.element_at(F.split("path", "/"), -1)
        kept = f"{self.root.rstrip('/')}-private"
        cut(ok.select(name.alias("name"), "text")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(kept)
        every = self.spark.read.schema("text string, name string").parquet(kept).select(F.col("name").alias("path"), "text")
        return self.build(every, "me", "text", tier=9, kind="personal") | {"refused": refused}

    def remember(self, note: str, today: str) -> dict:
        """A note of the person's own, as a private document."""
        return self.add(self.spark.createDataFrame([(f"note-{today}-{zlib.crc32(note.encode()):08x}.txt", note)], "path string, text string"))

    # --- searching -----------------------------------------------------------------

    def search_many(self, queries: list[str], k: int | None = None, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """The capped slate of each query: q, rank, id, citation, score, cosine, usable, served."""
        n = retrieve.slate_size(k)
        p = self.passages()
        # ids of shards are strings; pools rank by them and texts join after ranking
        q = self.spark.createDataFrame(list(enumerate(queries)), "q long, text string")
        lexical = retrieve.top(index.bm25(p, q, "id"), "bm25", retrieve.pool_size(n))
        matrix = np.array([self._vector(t) for t in queries])
        dense = retrieve.top(self._cosines(p, matrix), "cosine", retrieve.pool_size(n))
        fused = cut(retrieve.fuse(dense, lexical))
        # those of the lexical pool are scored, too, and no others again
        near = p.join(small_or_shuffled(fused.select("id").distinct()), "id")
        fused = fused.join(self._cosines(near, matrix), ["q", "id"])
        meta = p.select("id", "citation", "shard", "tier", "text", T.section_key(F.col("citation")).alias("section"))
        rows = retrieve.weigh(meta.join(fused, "id"), retrieve.tier_table(self.spark))
        rows = retrieve.without_siblings(retrieve.in_shards(rows, only), exclude or [])
        rows = retrieve.double_cap(rows)
        return retrieve.cut_usable(self._in_force(rows), n)

    def _vector(self, text: str) -> np.ndarray:
        v = np.array(self.client([embed.PREFIX["query"] + text])[0], np.float64)
        return v / max(np.linalg.norm(v), 1e-9)

    @staticmethod
    def _cosines(p: DataFrame, matrix: np.ndarray) -> DataFrame:
        """Exact cosine of every passage with each stated query, in matrix blocks."""
        import pyarrow as pa

        def run(batches):
            for b in batches:
                v = np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, matrix.shape[1])
                for q, scores in enumerate(matrix @ v.T):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, q, np.int64)), b.column("id"), pa.array(scores)], names=["q", "id", "cosine"])

        return p.select("id", F.col("embedding").cast("array<float>").alias("v")).where("v is not null").mapInArrow(run, "q long, id string, cosine double")

    def _in_force(self, rows: DataFrame) -> DataFrame:
        if self.register is None:
            return rows.withColumn("usable", F.lit(True)).withColumn("served", F.col("text"))
        red = validity.redacted(rows.select("id", "citation", "text").distinct(), self.register)
        return rows.join(red.select("id", "served", "suspended"), "id").withColumn("usable", ~F.col("suspended")).drop("suspended")

    def search(self, query: str, k: int | None = None, **options) -> DataFrame:
        return self.search_many([terminology.expand_text(query)], k, **options)

    # --- answering -----------------------------------------------------------------

    def ask(self, question: str, results: list[dict] | None = None, issues: list[str] | None = None, previous: str | None = None, k: int | None = None) -> dict:
        """What a caller needs to answer: findings or open questions first, then the slate.

        ``results`` are evaluated rules (rows of ``rules.RESULT``). If one needs a fact,
        the questions come back before any retrieval.
        """
        got, _ = self._asked(question, results, issues, previous, k)
        return got

    def _asked(self, question: str, results: list[dict] | None, issues: list[str] | None, previous: str | None, k: int | None) -> tuple[dict, list]:
        """What ``ask`` says, and the slate's rows (rank, served): the texts that the prompt shows."""
        results = results or []
        needs = [r["question"] for r in results if r["kind"] == "needs"]
        if needs:
            return {"status": "needs", "questions": needs}, []
        one = self.spark.createDataFrame([(question, previous)], "q string, before string")
        context = one.select(F.when(F.col("before").isNotNull() & T.needs_context(F.col("q")), F.concat("before", F.lit(" "), "q")).otherwise(F.col("q")).alias("query"), "q")
        row = context.select("query", terminology.excluded(F.col("query")).alias("exclude"), T.needs_bulletin(F.col("q")).alias("volatile")).first()
        queries = [terminology.expand_text(x) for x in (row["query"], *(issues or []))]
        slate = self.search_many(queries, k, exclude=list(row["exclude"]))
        if len(queries) > 1:
            merged = retrieve.merge_slates(self._numbered(slate), retrieve.slate_size(k)).select(F.lit(0).cast("long").alias("q"), "rank", F.col("id").alias("key"))
            keyed = slate.withColumn("key", F.xxhash64("id")).drop("q", "rank").dropDuplicates(["key"])
            slate = merged.join(keyed, "key").drop("key")
        gate = retrieve.gate(slate.withColumn("q", F.lit(0))).first()
        prompt = conversation.prompt(slate.select("q", "rank", "citation", "served")).first()
        rows = slate.orderBy("rank").select("rank", "id", "citation", "tier", F.round("cosine", 2).alias("cosine"), "usable", "served").collect()  # a slate
        sources = [{c: v for c, v in r.asDict().items() if c != "served"} for r in rows]
        return {
            "status": "ok" if gate and gate["passes"] else "declined",
            "findings": [r["decision"] for r in results if r["kind"] == "outcome"],
            "warnings": ["Cut-off dates move every month; confirm them."] if row["volatile"] else [],
            "sources": sources,
            "prompt": prompt["prompt"] if prompt else "",
        }, [(r["rank"], r["served"]) for r in rows]

    @staticmethod
    def _numbered(slate: DataFrame) -> DataFrame:
        return slate.select(F.lit(0).alias("question_id"), F.col("q").alias("qi"), "rank", F.xxhash64("id").alias("id"), "citation", "text", "score", "usable")

    def answer(self, question: str, chat: answering.Client, facts: str = "", k: int | None = None, results: list[dict] | None = None, previous: str | None = None) -> dict:
        """``ask`` with a model's part: issues planned, the answer cited and checked, loose duties attributed.

        A quote is kept if it stands in what the prompt showed, or in what a decided rule
        quotes (``quotes`` of its row of ``results``): these are further sources, numbered on
        from the slate's.
        """
        q = self.spark.createDataFrame([(0, question, facts)], "id long, question string, facts string")
        issues = [r.issue for r in answering.planned_issues(q, chat).orderBy("n").collect()]  # six at most
        got, served = self._asked(question, results, issues, previous, k)
        if got["status"] != "ok":
            return got
        told = [x for r in results or [] if r["kind"] == "outcome" for x in r.get("quotes") or []]
        texts = [(0, n, text or "") for n, text in served] + [(0, len(served) + n, x) for n, x in enumerate(told, 1)]
        texts = self.spark.createDataFrame(texts, "id long, source int, text string")
        prompt = self.spark.createDataFrame([(0, got["prompt"] + "\n\n" + question)], "id long, prompt string")
        answers, quotes = answering.cited_answers(prompt, texts, chat)
        text = answers.first().answer
        loose = answering.attributed_claims(prompt.select("id", "prompt", F.lit(text).alias("text"), F.lit(len(served) + len(told)).alias("n_sources")), chat)
        return got | {
            "answer": text,
            "quotes": [r.asDict() for r in quotes.orderBy("point", "part").select("source", "quote", "applies").collect()],
            "attributed": [r.asDict() for r in loose.orderBy("claim").select("text", "source").collect()],
        }

    # --- housekeeping ----------------------------------------------------------------

    def sources(self, definitions: DataFrame, today: str) -> DataFrame:
        """Definitions with chunks, age, staleness and whether they are built."""
        m = definitions.select(F.col("slug").alias("shard"), F.lit(None).cast("date").alias("fetched"), "refresh_days")
        return shards.summary(self.passages(), m, today).join(registry.missing(definitions, self.passages()).select(F.col("slug").alias("shard"), F.lit(True).alias("lacking")), "shard", "left").withColumn("built", F.col("lacking").isNull()).drop("lacking")


def to_json(result: dict) -> str:
    return json.dumps(result, ensure_ascii=False, default=str)
