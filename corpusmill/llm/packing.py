"""Token ids packed best-fit-decreasing into fixed rows, in binary form.

Texts are tokenised in the scan. Each document is cut losslessly into parts of at
most ``seq_len`` ids, and parts are dealt to groups of bounded size. A group packs its
parts longest first, each into the row with the least room that still holds it; the
row is found by a segment tree over capacities, whose leaves are the rows with that
much room. Full parts are rows of their own.

A packed row is written as bytes: its line of the id matrix (little-endian, two bytes an
id where the vocabulary allows, padded to ``seq_len``), the cumulative lengths of its
segments and the position resets, which are the offsets where positions start at 0
again (four bytes each). ``arrays`` reads them back as arrays.

The group of a part comes from a hash of id and text, the part's number, the task and
how often the task has met an equal row: neither a hot source, a group of copies, equal
rows without ids nor one long document fills a group. The number of partitions follows
the number of groups. For one partitioning of the input, reruns agree.

Defined results: null and empty texts have no ids and no segment; null ids are
carried as null; repeated rows are each packed; a very long text is tokenised whole, in
blocks whose seams change no id; parts of one length are packed by id, part and ids, and
of rows with the same room any may take a part; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.process_cache import frugal, kept
from corpusmill.plans.staging import small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
SEQ_LEN = 2048
PAD = 0
#: Bytes of text behind one packing group, and groups to a partition.
GROUP_BYTES = 2_000_000
GROUPS = 16
#: Characters tokenised at a time.
BLOCK = 1_000_000

PACKED = "pack_id long, n_tokens int, n_segments int, ids binary, cu_seqlens binary, position_resets binary, doc_ids array<bigint>, parts array<int>"
ARRAYS = "pack_id long, n_tokens int, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<bigint>, parts array<int>"


def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(name: str):
    return kept(("tiktoken", name), lambda: _encoding(name))


def encode(text: str, name: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text. Long texts are cut before a space between two letters,
    where the vocabulary's word pattern always ends a word, so the ids are those of the whole."""
    import re

    e = encoding(name)
    kind = np.uint16 if e.n_vocab <= 1 << 16 else np.uint32
    if len(text) <= BLOCK:
        return np.array(e.encode_ordinary(text), kind)
    seam, out, at = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])"), [], 0
    while at < len(text):
        m = seam.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = m.start() if m else len(text)
        out.append(np.array(e.encode_ordinary(text[at:end]), kind))
        at = end
    return np.concatenate(out)


def decode(ids: np.ndarray, name: str = VOCABULARY) -> str:
    return encoding(name).decode(ids.tolist())


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], int]:
    """Row of each length (given longest first) and the number of rows.

    The segment tree's leaf r is set if a row has exactly r room; a query walks
    to the leftmost set leaf at or above the length.
    """
    size = 1
    while size <= capacity:
        size *= 2
    tree, rows = [0] * (2 * size), [[] for _ in range(capacity + 1)]

    def change(r: int, by: int) -> None:
        r += size
        while r:
            tree[r] += by
            r >>= 1

    def least(need: int) -> int:
        node = need + size
        if tree[node]:
            return need
        while node > 1:  # climb to the first right sibling with a row, then down its left edge
            if node % 2 == 0 and tree[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - size
            node >>= 1
        return -1

    where, n = [], 0
    for x in lengths:
        r = least(x)
        if r < 0:
            row, r, n = n, capacity, n + 1
        else:
            row = rows[r].pop()
            change(r, -1)
        where.append(row)
        if r > x:
            rows[r - x].append(row)
            change(r - x, 1)
    return where, n


def _mixed(h: int, part: int, copy: int, task: int) -> int:
    """The hash of a part from that of its row."""
    x = (h ^ (part // 64 * 0x9E3779B97F4A7C15) ^ (copy * 0xC2B2AE3D27D4EB4F) ^ (task * 0x165667B19E3779F9)) & (1 << 64) - 1
    x = (x ^ x >> 31) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 29


def parts(docs: DataFrame, groups: int, seq_len: int = SEQ_LEN, name: str = VOCABULARY) -> DataFrame:
    """grp, doc_id, part, n, ids (little-endian binary) for every part of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            g, d, p, n, i = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.array(i, pa.binary())], names=["grp", "doc_id", "part", "n", "ids"])

        task, met = TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows = []
            for h, d, t in zip(b.column("h").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                ids = encode(t.as_py() or "", name)
                copy, met[h] = met[h], met[h] + 1
                for p, k in enumerate(range(0, len(ids), seq_len)):
                    x = ids[k : k + seq_len]
                    rows.append((_mixed(h, p, copy, task) % groups, d, p, len(x), x.tobytes()))
                    if len(rows) >= 512:
                        yield out(rows)
                        rows = []
            if rows:
                yield out(rows)

    small_batches(docs.sparkSession)
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return hashed.mapInArrow(frugal(run), "grp long, doc_id long, part int, n int, ids binary")


def _pack_group(t: pa.Table, seq_len: int, kind: type) -> pa.Table:
    t = t.sort_by([("n", "descending"), ("doc_id", "ascending"), ("part", "ascending"), ("ids", "ascending")])
    n = t.column("n").to_pylist()
    where, rows = best_fit(n, seq_len)
    ids, docs, part = t.column("ids"), t.column("doc_id").to_pylist(), t.column("part").to_pylist()
    held: list[list[int]] = [[] for _ in range(rows)]
    for k, row in enumerate(where):
        held[row].append(k)
    line = np.full(seq_len, PAD, kind)
    matrix, lengths, resets, used = [], [], [], []
    for ks in held:
        cu = np.cumsum([0] + [n[k] for k in ks]).astype("<i4")
        line[:] = PAD
        line[: cu[-1]] = np.frombuffer(b"".join(ids[k].as_py() for k in ks), kind)
        matrix.append(line.tobytes())
        lengths.append(cu.tobytes())
        resets.append(cu[:-1].tobytes())
        used.append(int(cu[-1]))
    group = t.column("grp")[0].as_py() if len(t) else 0
    return pa.table({
        "pack_id": pa.array([group << 24 | k for k in range(rows)], pa.int64()), "n_tokens": pa.array(used, pa.int32()), "n_segments": pa.array([len(ks) for ks in held], pa.int32()),
        "ids": pa.array(matrix, pa.binary()), "cu_seqlens": pa.array(lengths, pa.binary()), "position_resets": pa.array(resets, pa.binary()),
        "doc_ids": pa.array([[docs[k] for k in ks] for ks in held], pa.list_(pa.int64())), "parts": pa.array([[part[k] for k in ks] for ks in held], pa.list_(pa.int32())),
    })


def _kind(name: str) -> str:
    return "<u2" if encoding(name).n_vocab <= 1 << 16 else "<u4"


def matrices(docs: DataFrame, seq_len: int = SEQ_LEN, name: str = VOCABULARY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The packed rows of ``docs`` (doc_id, text) as bytes: see ``PACKED``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    kind = np.dtype(_kind(name))
    # partitions take turns, so none gets more than GROUPS groups, as hashed ones might
    n = -(-groups // GROUPS)
    dealt = parts(docs, groups, seq_len, name).withColumn("at", (F.col("grp") % n).cast("int")).repartitionById(n, "at")
    return dealt.groupBy("at", "grp").applyInArrow(lambda t: _pack_group(t, seq_len, kind), PACKED)


def arrays(packed: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """The rows of ``matrices`` read back as arrays, with a position for each id: see ``ARRAYS``."""
    kind = _kind(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cu, positions = [], [], []
            for x, c, r in zip(b.column("ids"), b.column("cu_seqlens"), b.column("position_resets")):
                ids.append(np.frombuffer(x.as_py(), kind).astype(np.int32))
                cu.append(np.frombuffer(c.as_py(), "<i4"))
                p, ends = np.zeros(len(ids[-1]), np.int32), cu[-1][1:]
                for lo, hi in zip(np.frombuffer(r.as_py(), "<i4").tolist(), ends.tolist()):
                    p[lo:hi] = np.arange(hi - lo)
                positions.append(p)
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("pack_id"), b.column("n_tokens"), pa.array(ids, kinds), pa.array(cu, kinds), pa.array(positions, kinds), b.column("doc_ids"), b.column("parts")], names=["pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "parts"])

    return packed.select("pack_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "parts").mapInArrow(run, ARRAYS)


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, name: str = VOCABULARY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The packed rows of ``docs`` as arrays: see ``ARRAYS``."""
    return arrays(matrices(docs, seq_len, name, group_bytes), name)


def binary(packed: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """pack_id, ids, cu_seqlens and position_resets as bytes again, from rows of arrays."""
    kind = _kind(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.asarray(x.values, kind).tobytes() for x in b.column("input_ids")]
            cu = [np.asarray(x.values, "<i4") for x in b.column("cu_seqlens")]
            yield pa.RecordBatch.from_arrays([b.column("pack_id"), pa.array(ids, pa.binary()), pa.array([c.tobytes() for c in cu], pa.binary()), pa.array([c[:-1].tobytes() for c in cu], pa.binary())], names=["pack_id", "ids", "cu_seqlens", "position_resets"])

    return packed.select("pack_id", "input_ids", "cu_seqlens").mapInArrow(run, "pack_id long, ids binary, cu_seqlens binary, position_resets binary")


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices(table(spark, sf_dir, "documents").select("doc_id", "text"))
