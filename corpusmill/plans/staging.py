"""Lineage cuts in the folder that driver and executors share, and size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that an operator may broadcast after counting it.
BROADCAST_ROWS = 200_000


_own: list[str] = []


def _temporary() -> str:
    """One folder of this process, for local sessions; removed at its end."""
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="corpusmill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    temporary folder; a cluster must name one that driver and executors share."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _temporary()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's file systems close."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)  # only what exists can be marked
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df`` has been counted to at most ``rows`` rows.

    Otherwise the frame comes back unhinted and joins as a shuffle, with
    adaptive skew handling. Counting reads at most ``rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it has fewer partitions than there are cores.

    A small table may be one row group and so one task, however much work its rows make.
    Tables of some size have more partitions than cores and come back as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def splittable(rows: DataFrame, unique: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to one row a key so that AQE can split a hot key's rows.

    A side that is already partitioned by the key (an aggregation's result) would join
    without a shuffle of its own, and then neither side can be split. A hash of the key as
    one more join column gives both sides their own.
    """
    k = F.xxhash64(*on).alias("_cm_split")
    return rows.select("*", k).join(unique.select("*", k), [*on, "_cm_split"], how).drop("_cm_split")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the Arrow batches in which texts reach Python, unless the session has set its own.

    The default of 64 MB a batch is held several times over by a task (row buffers, the
    socket, the worker); results do not depend on it.
    """
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if spark.conf.get(key, str(default)).rstrip("b") == str(default):
        spark.conf.set(key, str(size))
