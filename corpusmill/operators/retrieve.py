"""Pools, rank fusion, weights, caps, gate and slate merging.

Order of stages is semantics here: shard and sibling filters act after the pools,
the section cap acts on what the citation cap left. Ties always break by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.process_cache import frugal
from corpusmill.plans.staging import cut, small_batches

# Pool, fusion, caps, gate and tier weights.
TOP_K, RRF_K, CITATION_CAP, SECTION_CAP, MIN_SCORE, PRIMARY_SHARE = 12, 60, 3, 4, 0.62, 0.5
TIERS = {1: ("statute", 1.0), 2: ("regulation", 0.97), 3: ("policy", 0.92), 4: ("guidance", 0.88), 9: ("personal", 1.0)}
UNKNOWN_TIER = ("unknown", 0.8)


def slate_size(k: int | None) -> int:
    return k or TOP_K


def pool_size(k: int) -> int:
    return max(8 * k, 80)


def top(scores: DataFrame, score: str, n: int, id_col: str = "id", rank: str = "rank") -> DataFrame:
    """The n best rows of each query. The rank filter is pushed below the shuffle."""
    w = Window.partitionBy("q").orderBy(F.col(score).desc(), F.col(id_col))
    return scores.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= n)


def dense_top(vectors: DataFrame, queries: np.ndarray, n: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q, id, cosine, rank): exact scores of every vector against a block of queries.

    A partition multiplies whole batches and keeps its n best rows of each query,
    so only n rows a query and partition move. ``queries`` is a matrix that the
    caller holds; its size bounds what is shipped. Rows without an id or with a vector
    that is null, of another length or with null elements have no score (``unscored``).
    """
    d = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.empty(0, np.int64), np.empty((0, len(queries)))
        for b in batches:
            v = np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, d)
            ids, best = np.concatenate((ids, b.column("id").to_numpy())), np.concatenate((best, v @ queries.T))
            if len(ids) > 4 * n + 10_000:
                keep = np.unique(np.concatenate([np.lexsort((ids, -best[:, q]))[:n] for q in range(len(queries))]))
                ids, best = ids[keep], best[keep]
        for q in range(len(queries)):
            at = np.lexsort((ids, -best[:, q]))[:n]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int64)), pa.array(ids[at]), pa.array(best[at, q])], names=["q", "id", "cosine"])

    return top(_scored(vectors, d, id_col, vector).mapInArrow(run, "q long, id long, cosine double"), "cosine", n)


def _has_score(d: int, id_col: str, vector: str) -> Column:
    v = F.col(vector)
    return F.coalesce(F.col(id_col).isNotNull() & (F.size(v) == d) & ~F.exists(v, F.isnull), F.lit(False))


def _scored(vectors: DataFrame, d: int, id_col: str, vector: str) -> DataFrame:
    return vectors.where(_has_score(d, id_col, vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))


def unscored(vectors: DataFrame, d: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, size) of the rows that a search over vectors of length ``d`` leaves out."""
    return vectors.where(~_has_score(d, id_col, vector)).select(F.col(id_col).alias("id"), F.size(vector).alias("size"))


#: Vectors and queries that one multiplication takes.
CHUNK, BLOCK = 2048, 256
#: Decimals by which the scores of block searches rank.
DIGITS = 9
#: Bytes of query blocks that may be broadcast.
BLOCK_BYTES = 64 << 20
#: Bytes of a batch of pairs that a task takes at once; one pair at least.
BATCH_BYTES = 4 << 20


def dense_top_blocks(vectors: DataFrame, queries: DataFrame, n: int, d: int, id_col: str = "vec_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """(q, id, cosine, rank): the n best of all ``vectors`` for every row of ``queries``; q is its id.

    With ``group``, a column of ``vectors``, the n best of each of its values (null is one
    of them), and the column is in the result. Scores rank by ``DIGITS`` decimals, then by
    id: copies of a vector tie, wherever in a matrix they stand, however many there are.

    Both sides become matrices, of at most ``CHUNK`` and ``BLOCK`` rows; each pair of them
    is one multiplication of which n rows a query and group remain. Nothing is held by the
    driver, so queries and groups may grow with the table. The blocks of queries are
    broadcast if their bytes were summed to be few, and dealt out as a Cartesian product
    of blocks otherwise. Pairs reach Python a few at a time: a matrix stands in each of its
    pairs, and a batch of the default 64 MB would be held several times over by a task.
    """
    small_batches(vectors.sparkSession, BATCH_BYTES)
    kind = vectors.schema[group].dataType.simpleString() if group else "int"

    def matrices(rows: DataFrame, size: int, name: str, g: Column) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, parts, groups = [], [], []

            def out() -> pa.RecordBatch:
                g = pa.concat_arrays(groups)
                m = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (ids, parts)]
                return pa.RecordBatch.from_arrays([*m, pa.ListArray.from_arrays([0, len(g)], g)], names=[f"{name}_ids", f"{name}_m", f"{name}_g"])

            for b in batches:
                i, v = b.column("id").to_numpy(), np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, d)
                for k in range(0, len(i), size):
                    ids.append(i[k : k + size])
                    parts.append(v[k : k + size])
                    groups.append(b.column("g").slice(k, size))
                    if sum(map(len, ids)) >= size:
                        yield out()
                        ids, parts, groups = [], [], []
            if ids:
                yield out()

        scored = rows.where(_has_score(d, id_col, vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), g.alias("g"))
        t = kind if name == "v" else "int"
        return scored.mapInArrow(frugal(run), f"{name}_ids binary, {name}_m binary, {name}_g array<{t}>")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for vi, vm, vg, qi, qm in zip(*[b.column(c) for c in ("v_ids", "v_m", "v_g", "q_ids", "q_m")]):
                ids, qs = np.frombuffer(vi.as_py(), np.int64), np.frombuffer(qi.as_py(), np.int64)
                scores = np.frombuffer(qm.as_py(), np.float64).reshape(-1, d) @ np.frombuffer(vm.as_py(), np.float64).reshape(-1, d).T
                keys = np.round(scores, DIGITS)
                codes = vg.values.dictionary_encode(null_encoding="encode").indices.to_numpy()
                sizes = np.bincount(codes)
                nth = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place within its group, once sorted
                if len(sizes) == 1 and n < len(ids) and not np.isnan(keys).any():  # only what reaches the n-th is sorted
                    near = [np.flatnonzero(k >= np.partition(k, -n)[-n]) for k in keys]
                    at = np.stack([c[np.lexsort((ids[c], -k[c]))[:n]] for c, k in zip(near, keys)])
                else:
                    at = np.stack([np.lexsort((ids, -k, codes))[nth < n] for k in keys])
                cols = [pa.array(np.repeat(qs, at.shape[1])), pa.array(ids[at].ravel()), vg.values.take(pa.array(at.ravel()))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(np.take_along_axis(x, at, 1).ravel()) for x in (keys, scores))], names=["q", "id", "g", "key", "cosine"])

    blocks = cut(matrices(queries, BLOCK, "q", F.lit(0)))
    few = (blocks.agg(F.sum(F.octet_length("q_m"))).first()[0] or 0) <= BLOCK_BYTES
    pairs = matrices(vectors, CHUNK, "v", F.col(group) if group else F.lit(0)).crossJoin(F.broadcast(blocks) if few else blocks)
    found = pairs.mapInArrow(frugal(multiply), f"q long, id long, g {kind}, key double, cosine double")
    w = Window.partitionBy("q", "g").orderBy(F.col("key").desc(), "id")
    best = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    return best.select("q", *([F.col("g").alias(group)] if group else []), "id", "cosine", "rank")


def fuse(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """(q, id, fused): sum of reciprocal ranks over both pools; an absent side adds 0."""
    both = dense.select("q", "id", "rank").unionByName(lexical.select("q", "id", "rank"))
    return both.groupBy("q", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"))


def tier_table(spark) -> DataFrame:
    return spark.createDataFrame([(t, n, w) for t, (n, w) in sorted(TIERS.items())], "tier int, tier_name string, weight double")


def weigh(rows: DataFrame, tiers: DataFrame, score: str = "fused") -> DataFrame:
    """score * tier weight; an unknown tier weighs 0.8. The tier table has five rows."""
    x = rows.join(F.broadcast(tiers), "tier", "left")
    return x.withColumn("tier_name", F.coalesce("tier_name", F.lit(UNKNOWN_TIER[0]))).withColumn("score", F.col(score) * F.coalesce("weight", F.lit(UNKNOWN_TIER[1]))).drop("weight")


def under(citation: Column, prefix: Column) -> Column:
    """The citation is the prefix or one of its parts ("Ch 2" is not "Ch 20")."""
    return (citation == prefix) | F.rlike(F.substring(citation, F.length(prefix) + 1, F.lit(1)), F.lit(r"^[,(.]$")) & citation.startswith(prefix)


def without_siblings(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    for p in prefixes:
        rows = rows.where(~under(F.col("citation"), F.lit(p)))
    return rows


def in_shards(rows: DataFrame, shards: list[str] | None) -> DataFrame:
    return rows.where(F.col("shard").isin(shards)) if shards else rows


def cap(rows: DataFrame, n: int, *keys: str, score: str = "score", id_col: str = "id") -> DataFrame:
    """At most n rows of each query and key, the best first."""
    w = Window.partitionBy("q", *keys).orderBy(F.col(score).desc(), F.col(id_col))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def double_cap(rows: DataFrame, per_citation: int = CITATION_CAP, per_section: int = SECTION_CAP, **options) -> DataFrame:
    """Citation cap, then section cap over what it left: a greedy pass with both caps."""
    return cap(cap(rows, per_citation, "citation", **options), per_section, "section", **options)


def cut_usable(rows: DataFrame, k: int, usable: str = "usable", score: str = "score", id_col: str = "id") -> DataFrame:
    """Rows until k usable ones are in; others ride along without counting."""
    w = Window.partitionBy("q").orderBy(F.col(score).desc(), F.col(id_col))
    earlier = F.coalesce(F.sum(F.col(usable).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_n", earlier).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("_n") < k).drop("_n")


def gate(slate: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """(q, best, passes) over the returned slate; a query without rows has no row."""
    return slate.groupBy("q").agg(F.max("cosine").alias("best")).withColumn("passes", F.col("best") >= least)


def compatible(manifests: DataFrame, model: str) -> DataFrame:
    """Shards embedded by ``model`` or by an unnamed one, and a warning for the rest."""
    ok = F.col("embed_model").isNull() | F.col("embed_model").isin("", model)
    return manifests.withColumn("usable", ok).withColumn("warning", F.when(~ok, F.concat(F.lit("skipped "), "shard", F.lit(": embedded with "), "embed_model")))


MERGED = "question_id long, rank long, qi int, id long, citation string, score double, usable boolean"


def merge_slates(rows: DataFrame, k: int, per_citation: int = CITATION_CAP, per_section: int = SECTION_CAP, share: float = PRIMARY_SHARE) -> DataFrame:
    """One slate for each question from the slates of its queries (qi 0 is the question).

    Three rounds over (question_id, qi, rank, id, citation, text, score, usable):
    the question's own rows up to its share, then all queries in turn by rank, then
    what is left by query with the citation cap lifted to k. A passage counts once
    by citation and the first 80 characters. Stops strictly at k usable rows. A
    question's candidates are its queries times the slate size, so a group is small.
    """

    def run(t):
        rows = sorted(t.to_pylist(), key=lambda r: (r["qi"], r["rank"], r["id"]))
        floor = min(k, max(1, round(k * share)))
        taken, seen, cites, sections, usable = [], set(), {}, {}, 0

        def take(r: dict, cite_cap: int) -> None:
            nonlocal usable
            name, section = f"{r['citation']}|{(r['text'] or '')[:80]}", r["section"]
            if usable >= k or name in seen or cites.get(r["citation"], 0) >= cite_cap or sections.get(section, 0) >= per_section:
                return
            seen.add(name)
            cites[r["citation"]] = cites.get(r["citation"], 0) + 1
            sections[section] = sections.get(section, 0) + 1
            usable += bool(r["usable"])
            taken.append(r)

        for r in rows:
            if r["qi"] == 0 and usable < floor:
                take(r, per_citation)
        for r in sorted(rows, key=lambda r: (r["rank"], r["qi"], r["id"])):
            take(r, per_citation)
        for r in rows:
            take(r, k)
        cols = ["question_id", "rank", "qi", "id", "citation", "score", "usable"]
        out = [{**r, "rank": n} for n, r in enumerate(taken, 1)]
        return pa.table({c: pa.array([r[c] for r in out], t.schema.field(c).type if c != "rank" else pa.int64()) for c in cols})

    x = rows.select(F.col("question_id").cast("long").alias("question_id"), F.col("qi").cast("int").alias("qi"), F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("id"), "citation", "text", F.col("score").cast("double").alias("score"), "usable").withColumn("section", T.section_key(F.col("citation")))
    return x.groupBy("question_id").applyInArrow(run, MERGED)
