"""Vector code compression: product codes whose codebooks are searched by partial distances.

Components become the integers floor(1024 x). A vector is cut into ``PARTS`` equal
consecutive parts, each position has a codebook of at most ``ENTRIES`` entries, and a
part's code is the index of its nearest entry. Codebooks start as the parts of the
vectors with the smallest ids and are refined in ``ROUNDS`` rounds, each one pass over
the stored vectors: a task assigns its parts and adds them up by entry, so a round
shuffles at most one row for each task, part and entry.

The search of a part takes the dimensions by falling variance of the codebook. After
the leading ones the closest entry so far is measured completely, and then dimension by
dimension every pair of vector and entry whose sum strictly exceeds the vector's best
complete distance leaves the mask; what ties stays, and the lowest index wins. All
arithmetic is on integers: 64-bit ones where the largest component allows, else Python's.

Defined results: rows whose vector is null, or holds a null, NaN or infinite component,
are dropped; null ids come after all others when codebooks start, and equal ids by their
components; repeated rows each count and each get a code; equal distances go to the lower
index; vectors shorter than the longest, and lengths that four does not divide, are filled
up with zeros; an error too large for a long is null; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.process_cache import frugal
from corpusmill.plans.staging import cut, small_or_shuffled, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Dimensions summed for all entries before the first are dropped, and vectors searched at a time.
LEAD = 3
BLOCK = 2048
LONG = (1 << 63) - 1


class Codebooks(NamedTuple):
    """books[part][entry][position] as Python integers; exact: 64-bit integers do not overflow."""

    books: list[list[list[int]]]
    width: int
    exact: bool

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for entry in book for v in entry).encode()).hexdigest()


def finite(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows of ``vectors`` with a whole finite vector, as array<double> in ``vector``."""
    x = vectors.withColumn(vector, F.col(f"`{vector}`").cast("array<double>"))
    return x.where(F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))


def scaled(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def _matrix(column: pa.Array, width: int, exact: bool) -> np.ndarray:
    """The integer components of a batch, a row a vector, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    whole = np.floor(flat * SCALE).astype(np.int64) if exact else np.array([scaled(v) for v in flat.tolist()], object)
    if len(lengths) and (lengths == width).all():
        return whole.reshape(-1, width)
    out = np.zeros((len(lengths), width), whole.dtype)
    out[np.arange(width) < lengths[:, None]] = whole
    return out


def falling_variance(book: np.ndarray) -> list[int]:
    """Positions of ``book`` (entries, width) by falling variance, ties in place."""
    n, columns = len(book), book.T.tolist()
    spread = [n * sum(v * v for v in c) - sum(c) ** 2 for c in columns]
    return sorted(range(len(columns)), key=lambda d: -spread[d])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for each row of ``x``, and the squared distance."""
    order, n = falling_variance(book), len(x)
    if not order:
        return np.zeros(n, np.int64), np.zeros(n, x.dtype)
    total = np.zeros((n, len(book)), x.dtype)
    for d in order[:LEAD]:
        total += (x[:, d, None] - book[None, :, d]) ** 2
    first = total.argmin(axis=1)
    best = ((x - book[first]) ** 2).sum(axis=1)
    row, entry = np.nonzero(total <= best[:, None])
    total = total[row, entry]
    for d in order[LEAD:]:
        total = total + (x[row, d] - book[entry, d]) ** 2
        stays = total <= best[row]
        if not stays.all():
            row, entry, total = row[stays], entry[stays], total[stays]
    # pairs stand row by row, entries rising; the first entry of a row always stays
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(total, starts) if n else total
    ties = np.nonzero(total == least[row])[0]
    return entry[ties[np.searchsorted(row[ties], np.arange(n))]], least


def _assigned(column: pa.Array, codes: Codebooks) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, rows, parts of the vectors, index, distance), blocks of a batch in turn."""
    kind = np.int64 if codes.exact else object
    matrix = _matrix(column, codes.width * PARTS, codes.exact)
    for p, book in enumerate(codes.books):
        entries = np.array(book, kind).reshape(len(book), codes.width)
        for k in range(0, len(matrix), BLOCK):
            x = matrix[k : k + BLOCK, p * codes.width : (p + 1) * codes.width]
            yield p, slice(k, k + len(x)), x, *nearest(x, entries)


def _sums(vectors: DataFrame, codes: Codebooks) -> DataFrame:
    """(part, entry, n, sums) over all ``vectors`` (embedding): at most PARTS * ENTRIES rows."""
    kind = "long" if codes.exact else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = [len(b) for b in codes.books]
        count = [np.zeros(s, np.int64) for s in size]
        sums = [np.zeros((s, codes.width), np.int64 if codes.exact else object) for s in size]
        for b in batches:
            for p, _, x, at, _ in _assigned(b.column("embedding"), codes):
                np.add.at(count[p], at, 1)
                np.add.at(sums[p], at, x)
        rows = [(p, e, int(n), s.tolist() if codes.exact else [str(v) for v in s]) for p in range(PARTS) for e, (n, s) in enumerate(zip(count[p], sums[p])) if n]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64() if codes.exact else pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "entry", "n", "sums"])

    def together(t: pa.Table) -> pa.Table:
        columns = zip(*t.column("sums").to_pylist())
        return pa.table({"part": t.column("part")[:1], "entry": t.column("entry")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "sums": pa.array([[str(sum(map(int, c))) for c in columns]], pa.list_(pa.string()))})

    schema = f"part int, entry int, n long, sums array<{kind}>"
    rows = vectors.select("embedding").mapInArrow(frugal(run), schema)
    if not codes.exact:
        return rows.groupBy("part", "entry").applyInArrow(together, schema)
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(codes.width)]).cast("array<long>").alias("sums"))


def train(vectors: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks fitted to all ``vectors`` (vec_id, embedding as ``finite`` gives them, stored); None if there are none.

    The driver holds codebooks only: at most ENTRIES vectors.
    """
    n, longest, largest = vectors.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v))))).first()
    if not n:
        return None
    width, bound = -(-longest // PARTS), abs(scaled(largest or 0.0)) + 1
    exact = 4 * width * bound**2 < 1 << 62 and n * bound < 1 << 62
    first = vectors.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    whole = [[scaled(v) for v in r.embedding] + [0] * (PARTS * width - len(r.embedding)) for r in first]
    codes = Codebooks([[v[p * width : (p + 1) * width] for v in whole] for p in range(PARTS)], width, exact)
    for _ in range(rounds):
        books = [list(b) for b in codes.books]
        for r in _sums(vectors, codes).collect():
            books[r.part][r.entry] = [int(s) // r.n for s in r.sums]
        codes = codes._replace(books=books)
    return codes


def encode(vectors: DataFrame, codes: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) for every row of ``vectors`` (vec_id, label, embedding): two hex digits a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            index, error = np.zeros((len(column), PARTS), np.uint8), np.zeros(len(column), np.int64 if codes.exact else object)
            for p, rows, _, at, distance in _assigned(column, codes):
                index[rows, p] = at
                error[rows] += distance
            code, hexed = index.tobytes().hex(), 2 * PARTS
            errors = [e if e <= LONG else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([code[k : k + hexed] for k in range(0, len(code), hexed)], pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.select("vec_id", "label").dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(frugal(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(code: Column, codes: Codebooks) -> Column:
    """The vector that a code stands for, as array<double>: its entries' components over SCALE."""
    books = F.array(*[F.array(*[F.array(*[F.lit(v / SCALE) for v in e]) for e in b]) for b in codes.books])
    part = lambda p: F.get(F.get(books, F.lit(p)), F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int"))
    return F.concat(*[part(p) for p in range(PARTS)])


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, label, embedding).

    A label may hold most rows: errors are added up before they are shuffled, and the sums
    come back by a broadcast only if they were counted to be few.
    """
    x = cut(finite(vectors.select("vec_id", "label", "embedding")))
    codes = train(x)
    if codes is None:
        x = x.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return x.withColumn("codebooks_sha256", F.lit(""))
    coded = cut(encode(x, codes))
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    by_label = small_or_shuffled(by_label.withColumnRenamed("label", "_label"))
    y = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return y.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every round as CTEs: codebooks as rows (p, e, c) of double lists, which hold integers exactly."""
    out = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), q AS MATERIALIZED (
  SELECT r, p, c[p * len(c) // {PARTS} + 1:(p + 1) * len(c) // {PARTS}] AS x FROM v, range({PARTS}) AS t(p)
), b0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM q WHERE r < {ENTRIES})"""
    ]
    near = """a{k} AS MATERIALIZED (
  SELECT r, p, m.e AS e, m.d AS d FROM (
    SELECT r, q.p AS p, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS m
    FROM q JOIN b{k} AS b ON b.p = q.p GROUP BY r, q.p)
)"""
    for k in range(ROUNDS):
        out.append(near.format(k=k))
        out.append(
            f"""m{k} AS MATERIALIZED (
  SELECT p, e, list(s ORDER BY i) AS c FROM (
    SELECT a.p, a.e, i, floor(sum(x[i]) / count(*)) AS s FROM a{k} AS a JOIN q USING (r, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM q))) AS i) GROUP BY a.p, a.e, i
  ) GROUP BY p, e
), b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} AS b LEFT JOIN m{k} AS m USING (p, e))"""
        )
    out.append(near.format(k=ROUNDS))
    tail = f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM v JOIN (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r) USING (r)"""
    return "WITH " + ",\n".join(out) + tail


OP13_SQL = _sql()
