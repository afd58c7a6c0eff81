"""Vectors for passages: a client is called in batches, normalisation is native.

A client is any picklable function from a list of texts to a list of vectors, so a
model server, a local model or the hashing client below plug in alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.vectors import unit
from corpusmill.operators.ingest import to_embed

# Texts a call, and the prefix that marks a text's role.
BATCH = 64
PREFIX = {"passage": "search_document: ", "query": "search_query: "}

Client = Callable[[list[str]], list[list[float]]]


def hashing(dim: int = 64) -> Client:
    """A client without a model: signed word hashing. Deterministic, for tests and dry runs."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out

    return run


def vectors(rows: DataFrame, client: Client, id_col: str = "id", role: str = "passage") -> DataFrame:
    """(id, embedding) of unit length. Passages are embedded by their override if they have one."""
    prefix = PREFIX[role]
    text = to_embed() if "embed_text" in rows.columns else F.col("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("id"), b.column("t").to_pylist()
            got: list[list[float]] = []
            for k in range(0, len(texts), BATCH):
                got += client([prefix + (t or "") for t in texts[k : k + BATCH]])
            yield pa.RecordBatch.from_arrays([ids, pa.array(got, pa.list_(pa.float32()))], names=["id", "v"])

    kind = rows.schema[id_col].dataType.simpleString()
    raw = rows.select(F.col(id_col).alias("id"), text.alias("t")).mapInArrow(run, f"id {kind}, v array<float>")
    return raw.select("id", unit(F.col("v")).cast("array<float>").alias("embedding"))
