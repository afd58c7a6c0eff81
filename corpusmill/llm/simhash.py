"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 2 of their 8
bytes: they share at least 6 positional bytes, the guaranteed minimum. The bytes form
four pairs of positions, of which two at least are whole in such a pair of
fingerprints. A posting is thus keyed by two byte pairs (six postings a fingerprint,
four bytes a key; lists of single bytes would grow with the square of the corpus). A
list brings together what shares four positional bytes; there the shared bytes of each
pair are tallied over all positions, pairs with fewer than 6 are dropped, and the
differing bits of the others are verified.

A list longer than ``PAIRWISE`` is not compared pair by pair. Its postings are refined
by two of the four positions left, so that the tally of a pair that meets again has
reached 6; such a list holds at most 2^16 distinct fingerprints (two bytes are free),
and the 136 values within two bits of each are looked up, in linear work. Fingerprints
are made distinct first, so copies add nothing. A list yields a star for each group
that it links, not all pairs.

Defined results: null and empty texts have the fingerprint 0 and link like any
other; rows with null ids get a fingerprint and a component but cannot name one
(the smallest non-null id does; null if there is none); repeated rows each get a
row; a very long text is hashed whole, in blocks of shingles; an empty table gives an
empty result; other columns, whatever their names, are not read by
``near_duplicates`` and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.functions.process_cache import frugal
from corpusmill.plans.staging import cut, small_batches, small_or_shuffled, splittable, table

SHINGLE = 3
BITS = 2
SEED = 42
#: Positional bytes that linked fingerprints share at least.
SHARED = 8 - BITS
#: The byte positions of a posting: two of the four pairs of positions.
SETS = tuple(tuple(p for g in two for p in (2 * g, 2 * g + 1)) for two in combinations(range(4), 2))
#: Lists up to this length tally pair by pair; longer ones are refined first. Same links.
PAIRWISE = 48
#: Shingles hashed at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        words, size = [b" ".join(words)], 1
    else:
        size = SHINGLE
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        part = [h(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(len(part), 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp long) for every row of ``docs`` (doc_id, text); digest is of the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(fps.view(np.int64))], names=["doc_id", "digest", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text").alias("digest"), "text").mapInArrow(frugal(run), "doc_id long, digest long, fp long")


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _mask(positions: tuple[int, ...]) -> Column:
    m = sum(0xFF << 8 * p for p in positions)
    return F.lit(m - (1 << 64) if m >> 63 else m)


def tallied(fps: np.ndarray) -> np.ndarray:
    """Shared positional bytes of each pair of ``fps``: (m, m)."""
    m = len(fps)
    return ((fps[:, None] ^ fps[None, :]).reshape(m * m).view(np.uint8).reshape(m, m, 8) == 0).sum(axis=2)


def _stars(m: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(i, r) for i in range(m) if (r := find(i)) != i]


def _by_tally(fps: np.ndarray) -> list[tuple[int, int]]:
    """Star edges (index, index) of one short list: count filter, then the bits of what it leaves."""
    a, b = np.nonzero(np.triu(tallied(fps) >= SHARED, 1))
    ok = np.bitwise_count(fps[a] ^ fps[b]) <= BITS
    return _stars(len(fps), a[ok], b[ok])


_NEAR = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], np.int64)


def _by_lookup(fps: np.ndarray, free: tuple[int, ...]) -> list[tuple[int, int]]:
    """The same for distinct fingerprints that share the six positions not in ``free``."""
    m, low = len(fps), np.zeros(len(fps), np.int64)
    for k, p in enumerate(free):
        low |= ((fps >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << 8 * k
    at = np.full(1 << 16, -1, np.int64)
    at[low] = np.arange(m)
    other = at[low[:, None] ^ _NEAR[None, :]]
    a, k = np.nonzero(other > np.arange(m)[:, None])
    return _stars(m, a, other[a, k])


def _lists(postings: DataFrame, handle: Callable, bound: int | None) -> DataFrame:
    """(a, b) or, for members of lists longer than ``bound``, (fp, null) with the list's s.

    ``handle`` gets the positions' number and the distinct fingerprints of a list. No
    more than ``bound`` rows of a longer list are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int8, np.int64, np.int64)]
        spilling = None  # the long list whose rows are passed on
        for last, b in _flagged(batches):
            if b is not None:
                held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, b.columns)]
            hs, hk, hf = held
            change = np.nonzero((hk[1:] != hk[:-1]) | (hs[1:] != hs[:-1]))[0] + 1
            edges = np.concatenate(([0], change, [len(hf)])).astype(np.int64).tolist() if len(hf) else [0]
            out, rest = [(np.empty(0, np.int64), np.empty(0, np.int64), 0)], 0
            for lo, hi in zip(edges, edges[1:]):
                name, full = (hs[lo], hk[lo]), hi < len(hf) or last
                if name == spilling or bound is not None and hi - lo > bound:
                    spilling = name
                    out.append((hf[lo:hi], None, int(hs[lo])))
                elif full and hi - lo > 1:
                    part = hf[lo:hi]
                    pairs = np.array(handle(int(hs[lo]), part.view(np.uint64)), np.int64).reshape(-1, 2)
                    out.append((part[pairs[:, 0]], part[pairs[:, 1]], 0))
                elif not full:
                    break
                rest = hi
            held = [h[rest:] for h in held]
            a = np.concatenate([x for x, _, _ in out])
            found = pa.concat_arrays([pa.nulls(len(x), pa.int64()) if y is None else pa.array(y, pa.int64()) for x, y, _ in out])
            yield pa.RecordBatch.from_arrays([pa.array(a), found, pa.array(np.repeat([s for _, _, s in out], [len(x) for x, _, _ in out]).astype(np.int8))], names=["a", "b", "s"])

    return postings.repartition("s", "k").sortWithinPartitions("s", "k", "fp").mapInArrow(frugal(run), "a long, b long, s tinyint")


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for b in batches:
        yield False, b
    yield True, None


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``distinct`` (fp) that link.

    Edges of one list are reduced to stars; over all lists their transitive
    closure is that of all links.
    """

    def posting(s: int, positions: tuple[int, ...]) -> Column:
        return F.struct(F.lit(s).cast("tinyint").alias("s"), F.col("fp").bitwiseAND(_mask(positions)).alias("k"))

    postings = distinct.select("fp", F.explode(F.array(*[posting(s, p) for s, p in enumerate(SETS)])).alias("p")).select("p.s", "p.k", "fp")
    found = cut(_lists(postings, lambda s, fps: _by_tally(fps), PAIRWISE))
    # a long list is refined by two of the positions that its key leaves open
    finer = [(s, p + two) for s, p in enumerate(SETS) for two in combinations([x for x in range(8) if x not in p], BITS)]
    keys = F.filter(F.array(*[F.when(F.col("s") == s, posting(n, p)) for n, (s, p) in enumerate(finer)]), lambda x: x.isNotNull())
    long = found.where("b is null").select(F.col("a").alias("fp"), "s").select("fp", F.explode(keys).alias("p")).select("p.s", "p.k", "fp").distinct()
    free = [tuple(x for x in range(8) if x not in p) for _, p in finer]
    refined = _lists(long, lambda n, fps: _by_lookup(fps, free[n]), None)
    return found.where("b is not null").select("a", "b").unionByName(refined.select("a", "b"))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, fp) of ``docs``, and the class of each distinct fp.

    A class is (fp, component_id, first): its smallest id, and its first (id, digest),
    by id with null last.
    """
    rows = cut(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(order).alias("first")))
    comp = components(links(nodes.select("fp")))
    # only linked fingerprints need a class; the others stand for themselves
    own = comp.join(nodes, comp["node"] == nodes["fp"]).groupBy("component").agg(F.min("least").alias("l"), F.min("first").alias("f"))
    linked = comp.join(own, "component").select(F.col("node").alias("fp"), "l", "f")
    return rows, nodes.join(linked, "fp", "left").select("fp", F.coalesce("l", "least").alias("component_id"), F.coalesce("f", "first").alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text)."""
    rows, classes = grouped(docs)
    return splittable(rows, classes.select("fp", "component_id"), ["fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group.

    A row is judged by its own id and text, so that of an id with several texts only
    those go that are copies. Its group keeps the smallest id (null after all others)
    and, of several texts of that id, one; rows equal in id and text all stay with it.
    """
    rows, classes = grouped(docs)
    marks = splittable(rows, classes.select("fp", "first"), ["fp"])
    copies = marks.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))))
    gone = small_or_shuffled(cut(copies.select(F.col("doc_id").alias("_cm_id"), F.col("digest").alias("_cm_digest")).distinct()))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_cm_id"]) & (_digest("text") == gone["_cm_digest"]), "left_anti")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
