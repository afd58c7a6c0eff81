"""Merkle dataset manifest: a tree a group, built over range-sorted rows, and a tree over the groups.

A leaf is the digest of a row. Leaves are range-sorted by group and order and stored once,
so that a range keeps its rows. Each range counts the leaves of its first and last group;
summed up along the ranges, the counts give every leaf its place in its group. A range then
builds what it holds whole: a run of ``FANOUT`` consecutive nodes (or the last, shorter one)
becomes the digest of its nodes' digests, level upon level, in memory of one run a level.
Only the ragged nodes at a range's borders are shuffled, by their coordinate (group, level,
run), at most 2 * FANOUT a level and range; the upper levels are finished from them, a level
a job. The groups' roots are leaves of a second tree of the same kind.

A proof lists the runs from a leaf to the root: its own place and its siblings' digests.
For it, a range's rows meet the few border runs that the range touches; everything else it
builds again by itself. ``folded`` recomputes a root from a leaf and a proof.

Defined results: a null value is written as ``-``; null groups are a group of their own and
come first; null ids come before others, and rows that tie in id follow their leaves' digests;
repeated rows are each a leaf; a very long text is one leaf; a group of one leaf has that leaf as
its root; an empty table gives an empty result; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.process_cache import frugal
from corpusmill.plans.staging import cut, splittable, table

FANOUT = 16
HEX = 64
#: Leaves of a range, and ranges at most (their counts are broadcast: three longs each).
RANGE_ROWS = 25_000
RANGES = 20_000
#: Proofs handed on at a time.
BATCH = 500

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<place:int,siblings:string>>"


def hashed(*values: Column) -> Column:
    """The digest of the values: ``-`` for null, else UTF-8 length, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _runs(nodes: int, level: int) -> int:
    """Nodes of a level over so many leaves."""
    return -(-nodes // FANOUT**level)


def _ranged(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, ord, .., leaf) range-sorted and stored, with _range and _at, which rises with the order.

    A row number breaks ties, so that equal rows do not crowd one range.
    """
    x = cut(leaves).withColumn("_uid", F.monotonically_increasing_id())
    n = x.count()
    order = ["grp", "ord", "leaf", "_uid"]
    ranges = max(1, -(-n // max(RANGE_ROWS, n // RANGES)))
    x = x.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return cut(x.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).drop("_uid"))


def _segments(ranged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_range, grp, c, before, n) of the first and last group of each range, and (_range, grp, c) of all.

    A group that goes over a range's border is the last of one range and the first of the next.
    """
    counts = cut(ranged.groupBy("_range", "grp").agg(F.count("*").alias("c")))
    ends = counts.groupBy("_range").agg(F.min(F.struct("grp", "c")).alias("lo"), F.max(F.struct("grp", "c")).alias("hi"))
    ends = ends.select("_range", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e")).select("_range", "e.grp", "e.c")
    along = Window.partitionBy("grp").orderBy("_range")
    ends = ends.withColumn("before", F.sum("c").over(along) - F.col("c"))
    return cut(ends.withColumn("n", F.sum("c").over(Window.partitionBy("grp")))), counts


class _Growing:
    """A group's nodes as its leaves come: complete runs become parents, others are ragged."""

    def __init__(self, grp: str, before: int):
        self.grp, self.before, self.seen, self.held, self.out = grp, before, 0, [], []

    def add(self, digest: str) -> None:
        self._push(0, self.before + self.seen, digest)
        self.seen += 1

    def _push(self, level: int, at: int, digest: str) -> None:
        while True:
            if level == len(self.held):
                self.held.append([])
            run = at // FANOUT
            if run * FANOUT < _runs(self.before, level):  # began in an earlier range
                self.out.append((level, at, digest))
                return
            self.held[level].append((at, digest))
            if at % FANOUT < FANOUT - 1:
                return
            digest = hashlib.sha256("".join(d for _, d in self.held[level]).encode()).hexdigest()
            self.held[level] = []
            level, at = level + 1, run

    def end(self, n: int | None = None) -> list[tuple]:
        """(grp, n, level, at, digest) of the ragged nodes, or of the root; n: the group's leaves, if they go on."""
        last = self.before + self.seen
        n = last if n is None else n
        level = 0
        while last == n and _runs(n, level) > 1:
            if level < len(self.held) and self.held[level]:
                at, nodes = self.held[level][0][0] // FANOUT, self.held[level]
                self.held[level] = []
                self._push(level + 1, at, hashlib.sha256("".join(d for _, d in nodes).encode()).hexdigest())
            level += 1
        rest = [(level, at, d) for level, nodes in enumerate(self.held) for at, d in nodes]
        return [(self.grp, n, *x) for x in self.out + rest]


NODES = "grp string, n long, level int, at long, digest string"


def _borders(ranged: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes that no range can put into a parent by itself: ``NODES``."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["grp", "n", "level", "at", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, rows, lo, hi = None, True, [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            before, lo, hi = (b.column(c)[0].as_py() for c in ("before", "lo", "hi"))
            for grp, leaf in zip(b.column("grp").to_pylist(), b.column("leaf").to_pylist()):
                if now is None or grp != now.grp:
                    if now is not None:
                        rows += now.end(lo if first else None)
                        first = False
                    now = _Growing(grp, before if now is None else 0)
                now.add(leaf)
            if len(rows) >= 10_000:
                yield out(rows)
                rows = []
        if now is not None:
            rows += now.end(lo if first else hi)
        yield out(rows)

    at = ends.groupBy("_range").agg(F.min_by("before", "grp").alias("before"), F.min_by("n", "grp").alias("lo"), F.max_by("n", "grp").alias("hi"))
    x = ranged.select("_range", "grp", "leaf").join(F.broadcast(at), "_range")  # a row a range: RANGES at most
    return x.select("grp", "leaf", "before", "lo", "hi").mapInArrow(frugal(run), NODES)


def _finished(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (grp, level, run, digests) above the border ``nodes``, and roots (grp, root)."""
    nodes = cut(nodes)
    n = nodes.agg(F.max("n")).first()[0] or 0
    levels = next(k for k in range(64) if _runs(n, k) <= 1)
    now, runs, roots = nodes.where("level = 0"), None, None
    for k in range(levels + 1):
        width = FANOUT**k
        top = F.col("n") <= width
        done = now.where(top).select("grp", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        if k == levels:
            break
        run = now.where(~top).groupBy("grp", "n", F.shiftright("at", FANOUT.bit_length() - 1).alias("run"))
        digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x.digest), "")
        made = cut(run.agg(digests.alias("digests")).select("grp", "n", F.lit(k).alias("level"), "run", "digests"))
        runs = made if runs is None else runs.unionByName(made)
        parents = made.select("grp", "n", F.lit(k + 1).alias("level"), F.col("run").alias("at"), F.sha2("digests", 256).alias("digest"))
        now = nodes.where(F.col("level") == k + 1).unionByName(parents)
    if runs is None:
        runs = nodes.select("grp", "n", "level", F.col("at").alias("run"), F.col("digest").alias("digests")).where("false")
    return runs.select("grp", "level", "run", "digests"), roots


def _touched(ends: DataFrame) -> DataFrame:
    """(_range, grp, level, run): the runs that a range holds in part only."""
    a, b = F.col("before"), F.col("before") + F.col("c")
    bits = FANOUT.bit_length() - 1
    x = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(64 // bits - 2))).alias("level")).withColumn("width", F.expr(f"shiftleft(1L, {bits} * (level + 1))"))
    x = x.where(F.col("n") * FANOUT > F.col("width"))  # more than one node
    x = x.select("*", F.explode(F.array_distinct(F.array(F.expr("before div width"), F.expr("(before + c - 1) div width")))).alias("run"))
    lo, hi = F.col("run") * F.col("width"), F.least((F.col("run") + 1) * F.col("width"), F.col("n"))
    return x.where((lo < a) | (hi > b)).select("_range", "grp", "level", "run")


def _path(runs: list[dict[int, str]], at: int) -> list[tuple[int, str]]:
    """(place, siblings) from level to level for the node ``at`` of the first level in ``runs``."""
    out = []
    for held in runs:
        place = at % FANOUT
        at //= FANOUT
        d = held[at]
        out.append((place, d[: HEX * place] + d[HEX * (place + 1) :]))
    return out


def _segment_proofs(leaves: list[str], before: int, n: int, border: dict[tuple[int, int], str], above: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The proof of each leaf of a group's part in one range, in order."""
    runs, start, nodes, level = [], before, leaves, 0
    while (here := _runs(n, level)) > 1:
        held = {r: d for (k, r), d in border.items() if k == level}
        parents, first = [], -(-start // FANOUT)
        r = first
        while min((r + 1) * FANOUT, here) <= start + len(nodes) and r * FANOUT < here:
            held[r] = "".join(nodes[r * FANOUT - start : (r + 1) * FANOUT - start])
            parents.append(hashlib.sha256(held[r].encode()).hexdigest())
            r += 1
        runs.append(held)
        start, nodes, level = first, parents, level + 1
    run, rest = None, []
    for k in range(before, before + len(leaves)):
        if run != k // FANOUT:
            run, rest = k // FANOUT, _path(runs[1:], k // FANOUT)
        yield _path(runs[:1], k) + rest + above


def _proofs(ranged: DataFrame, ends: DataFrame, counts: DataFrame, runs: DataFrame, above: DataFrame | None) -> DataFrame:
    """(row, leaf, root, proof) for every leaf; ``above`` (grp, root, proof) has the group's root and what goes on after it."""
    inner = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in ranged.schema["row"].dataType.fields) + ">"
    empty = {"_at": "long", "level": "int", "run": "long", "digests": "string", "before": "long", "n": "long", "root": "string", "above": PROOF, "row": inner, "leaf": "string"}

    def shaped(df: DataFrame) -> DataFrame:
        return df.select("_range", "grp", *[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    # what a range must know: its borders' places, the border runs, and what is above each group
    known = ends.select("_range", "grp", "before", "n")
    known = counts.withColumn("before", F.lit(0)).join(known.select("_range", "grp", F.col("before").alias("b"), F.col("n").alias("total")), ["_range", "grp"], "left").select("_range", "grp", F.coalesce("b", "before").alias("before"), F.coalesce("total", "c").alias("n"))
    if above is not None:
        known = splittable(known, above.select("grp", "root", F.col("proof").alias("above")), ["grp"])
    context = shaped(known).unionByName(shaped(_touched(ends).join(runs, ["grp", "level", "run"])))
    ranges = max(1, ranged.rdd.getNumPartitions())
    dealt = context.unionByName(shaped(ranged)).repartitionById(ranges, "_range").sortWithinPartitions("_range", F.col("_at").asc_nulls_first())
    proof = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(places: dict, border: dict, grp: str | None, leaves: list[str], spans: list[list]) -> Iterator[pa.RecordBatch]:
            if not leaves:
                return
            before, n, root, above = places[grp]
            row, k, paths = pa.concat_arrays([c.slice(a, b - a) for c, a, b in spans]), 0, []
            for p in _segment_proofs(leaves, before, n, border.get(grp, {}), above):
                paths.append(p)
                if len(paths) == BATCH or k + len(paths) == len(leaves):
                    m = len(paths)
                    as_rows = pa.array([[{"place": a, "siblings": s} for a, s in x] for x in paths], proof)
                    yield pa.RecordBatch.from_arrays([row.slice(k, m), pa.array(leaves[k : k + m], pa.string()), pa.array([root] * m, pa.string()), as_rows], names=["row", "leaf", "root", "proof"])
                    k, paths = k + m, []

        places, border, now, leaves, spans, here = {}, {}, None, [], [], None
        for b in batches:
            row = b.column("row")
            at, grps = b.column("_at").to_pylist(), b.column("grp").to_pylist()
            ranges, digests = b.column("_range").to_pylist(), b.column("leaf").to_pylist()
            for k in range(b.num_rows):
                if ranges[k] != here or grps[k] != now and at[k] is not None:
                    yield from emit(places, border, now, leaves, spans)
                    leaves, spans, now = [], [], grps[k]
                if ranges[k] != here:
                    places, border, here = {}, {}, ranges[k]
                if at[k] is not None:
                    leaves.append(digests[k])
                    if not spans or spans[-1][0] is not row:
                        spans.append([row, k, k])
                    spans[-1][2] = k + 1
                elif (level := b.column("level")[k].as_py()) is None:
                    above = [(x["place"], x["siblings"]) for x in b.column("above")[k].as_py() or []]
                    places[grps[k]] = (b.column("before")[k].as_py(), b.column("n")[k].as_py(), b.column("root")[k].as_py(), above)
                else:
                    border.setdefault(grps[k], {})[level, b.column("run")[k].as_py()] = b.column("digests")[k].as_py()
        yield from emit(places, border, now, leaves, spans)

    return dealt.mapInArrow(frugal(run), f"row {inner}, leaf string, root string, proof {PROOF}")


def _tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    ranged = _ranged(leaves)
    ends, counts = _segments(ranged)
    runs, roots = _finished(_borders(ranged, ends))
    return ranged, ends, counts, cut(runs), cut(roots)


def manifest(docs: DataFrame, leaf: Column, group: str, order: str, carry: list[Column]) -> DataFrame:
    """The ``carry`` columns of every row, with leaf, subroot (of its group), root and proof.

    ``leaf`` is the digest column; groups and rows ascend, nulls first.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = docs.select(key.alias("grp"), F.col(order).alias("ord"), leaf.alias("leaf"), F.struct(*carry).alias("row"))
    ranged, ends, counts, runs, roots = _tree(leaves)
    # the groups' roots are the leaves of one more group
    tops = roots.select(F.lit("").alias("grp"), F.col("grp").alias("ord"), F.col("root").alias("leaf"), F.struct("grp").alias("row"))
    above = _tree(tops)
    root = above[4].first()
    paths = cut(_proofs(*above[:4], None).select("row.grp", F.col("leaf").alias("root"), "proof"))
    x = _proofs(ranged, ends, counts, runs, paths)
    return x.select("row.*", "leaf", F.col("root").alias("subroot"), F.lit(root.root if root else None).cast("string").alias("root"), "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    joined = lambda cur, s: F.concat(F.substring(s.siblings, F.lit(1), s.place * HEX), cur, F.substring(s.siblings, s.place * HEX + 1, F.lit(FANOUT * HEX)))
    return F.aggregate(proof, leaf, lambda cur, s: F.sha2(joined(cur, s), 256))


def siblings_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: s.siblings), ""), 256)


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text was lower-cased (A-Z) where 5 divides crc32 of its id; null elsewhere."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = [F.col(c) if c != "text" else F.translate("text", upper, upper.lower()) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, hashed(*values))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    x = manifest(docs, hashed(*[F.col(c) for c in FIELDS]), "source", "doc_id", [F.col("doc_id"), tampered(docs).alias("bad")])
    x = x.withColumn("folded_root", folded(F.coalesce("bad", "leaf"), F.col("proof")))
    return x.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_PIECES = " || ".join(f"coalesce(strlen({{{c}}}) || ':' || {{{c}}}, '-')" for c in range(5))
_PIECES = _PIECES.replace("{0}", "doc_id::VARCHAR").replace("{1}", "source").replace("{2}", "lang").replace("{3}", "n_chars::VARCHAR")
#: Bit by bit over the digits of the id; the polynomial is that of CRC-32.
_CRC = "xor(list_reduce(range(0, 8 * strlen({s})), lambda c, k: xor(xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr({s}, k // 8 + 1, 1)) ELSE 0 END) >> 1, (xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr({s}, k // 8 + 1, 1)) ELSE 0 END) & 1) * 3988292384), 4294967295), 4294967295)".replace("{s}", "doc_id::VARCHAR")
_TREE = """{t} AS (
  SELECT 0 AS k, grp, i, n, leaf AS d FROM {rows}
  UNION ALL
  SELECT k + 1, grp, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY k, grp, i // 16, n
)"""
_RUNS = "{r} AS MATERIALIZED (SELECT k, grp, i // 16 AS run, string_agg(d, '' ORDER BY i) AS ds FROM {t} WHERE n > 1 GROUP BY k, grp, i // 16)"
_WALK = """{w} AS (
  SELECT r, 0 AS k, grp, i, n, {proof} AS proof, {cur} AS cur FROM {rows}
  UNION ALL
  SELECT w.r, w.k + 1, w.grp, w.i // 16, (w.n + 15) // 16, w.proof || s.ds[:64 * (w.i % 16)] || s.ds[64 * (w.i % 16) + 65:],
         sha256(s.ds[:64 * (w.i % 16)] || w.cur || s.ds[64 * (w.i % 16) + 65:])
  FROM {w} AS w JOIN {runs} AS s ON s.k = w.k AND s.grp = w.grp AND s.run = w.i // 16
)"""
OP11_SQL = (
    "WITH RECURSIVE h AS MATERIALIZED (SELECT *, coalesce('=' || source, '-') AS grp, sha256(" + _PIECES.replace("{4}", "text") + ") AS leaf, "
    + "CASE WHEN " + _CRC + " % 5 = 0 THEN sha256(" + _PIECES.replace("{4}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + ") END AS bad FROM documents), "
    + "a AS MATERIALIZED (SELECT doc_id, grp, leaf, coalesce(bad, leaf) AS start, row_number() OVER () AS r, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM h), "
    + _TREE.format(t="t", rows="a") + ", " + _RUNS.format(r="tr", t="t") + ", "
    + "b AS MATERIALIZED (SELECT '' AS grp, grp AS r, d AS leaf, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1), "
    + _TREE.format(t="u", rows="b") + ", " + _RUNS.format(r="ur", t="u") + ", "
    + _WALK.format(w="x", proof="''", cur="start", rows="a", runs="tr") + ", "
    + "c AS MATERIALIZED (SELECT x.r, '' AS grp, b.i, b.n, x.proof, x.cur, b.leaf AS subroot FROM x JOIN b ON b.r = x.grp WHERE x.n = 1), "
    + _WALK.format(w="y", proof="proof", cur="cur", rows="c", runs="ur")
    + """
SELECT doc_id, a.leaf, subroot, (SELECT d FROM u WHERE n = 1) AS root, sha256(y.proof) AS proof_sha256, y.cur AS folded_root, y.cur = (SELECT d FROM u WHERE n = 1) AS verified
FROM y JOIN a USING (r) JOIN c USING (r) WHERE y.n = 1"""
)
