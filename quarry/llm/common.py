"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.session import ship

#: What separates words in every contract of this folder: ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may name none: there the warehouse, on the one machine, takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, tidy: bool = True) -> DataFrame:
    """``df`` through a table in the shared folder: a cut of the lineage that outlives executors.

    tidy: lets Spark drop the shuffle files that only led to this table.
    """
    spark = session_of(df)
    path = shared_dir(spark)
    df.write.parquet(path)
    if tidy:
        del df
        release(spark)
    return spark.read.parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the folders of tables that :func:`written` gave and nothing reads any more."""
    for df in tables:
        spark = session_of(df)
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, upon which Spark removes the shuffles nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drawn(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of ``key``: always the same ones of a table.

    A hash of its own first thins larger tables to about 2n rows, so that what
    tasks send to where the n are picked does not grow with the table.
    """
    total = native_count(df)
    if total > 4 * n:
        df = df.where(F.pmod(F.xxhash64(key, F.lit(77)), F.lit(1 << 40)) < int((1 << 40) * 2 * n / total))
    return df.orderBy(F.xxhash64(key), key).limit(n)


def text_buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, column: str, most: int = 8 << 20):
    """Record batches cut so that the texts of one piece are about ``most`` bytes (one text at least)."""
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        n = len(size)
        if not n:
            continue
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(size), 0), np.int64)
        cuts = np.cumsum(lengths) // most
        starts = np.flatnonzero(np.r_[True, cuts[1:] != cuts[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], n]):
            yield batch.slice(a, b - a)


def stretches(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Numbers the stretches between neighbouring ``edges``: equal numbers for equal bytes, and the bytes of each number.

    Arrow's dictionary compares the bytes themselves, so that no hash decides.
    """
    column = encoded(raw, edges)
    return column.indices.to_numpy(), column.dictionary.to_pylist()


def encoded(raw: np.ndarray, edges: np.ndarray) -> pa.DictionaryArray:
    offsets = pa.py_buffer(np.ascontiguousarray(edges, np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()


def trimmed(run):
    """``run`` of a ``mapInArrow``; its worker gives free memory back to the system at the end of a task.

    Workers stay for later tasks, and an executor's limit holds for idle and busy ones together.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without this call
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def native_count(df: DataFrame) -> int:
    return df.select(F.count(F.lit(1))).first()[0]
