"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side of a join is broadcast; larger sides are shuffled.
BROADCAST_BYTES = 16 << 20

#: Whether a finished query's shuffle files go at once or when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch between Spark and its Python workers: texts are long.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: Resident bytes up to which a Python worker has nothing to give back.
SMALL_WORKER = 256 << 20

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which driver
    and executors share; a temporary one only where that setting is unset and Spark runs
    on this machine alone (tests); elsewhere an unset folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts
    lineage, survives lost executors, and fixes values such as generated row keys.
    Once the table stands, the shuffle files that it was made from are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing needs them any more."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, getattr(table, "_written_to", None)
        if path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def _row_bytes(df: DataFrame) -> int:
    """What a row takes in a broadcast, about; texts and digests count as 48 bytes."""
    return 16 + sum(48 if f.dataType.typeName() in ("string", "binary") else 8 for f in df.schema.fields)


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it takes at most ``most`` bytes, else as it is,
    for a shuffled join. Pass a materialized frame of short values: it is counted."""
    rows = most // _row_bytes(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores behind it until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_keys(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a written table with a key of each row's own, and that column's name,
    which ``df`` doesn't use; ids may be null or repeat, and a key that isn't written
    could change whenever it is computed."""
    key = free_name("row_key", df)
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), name), key


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def small_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """``df``, after its session was told to send batches of ``most`` bytes to Python workers;
    the queries made from it are planned later, so the setting stays."""
    df.sparkSession.conf.set(BATCH_CONF, str(most))
    return df


def give_back() -> None:
    """Return freed memory to the system: Spark uses a Python worker again for other tasks,
    and what it keeps is missing elsewhere in the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _resident() -> int:
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:  # another system
        return SMALL_WORKER + 1


def tidy(rows: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``rows``, a function for mapInPandas, that gives memory back when its task ends, unless
    its worker is small: collecting takes longer than many a small task."""

    @wraps(rows)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from rows(batches)
        finally:
            if _resident() > SMALL_WORKER:
                give_back()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
