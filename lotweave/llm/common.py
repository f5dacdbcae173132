"""Small helpers that the text operators share: durable intermediate tables, Arrow text access, input tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a worker handles at once; what it holds follows from this and not from the partition's size.
BATCH_BYTES = 2 << 20

#: Bytes of an Arrow batch between Spark and a worker (64 MB if left alone): both sides hold a few of them.
ARROW_BATCH, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_written: list[tuple[SparkSession, str]] = []
_collect = [_written]
_scratches: list[list] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    found = "file://" + tempfile.mkdtemp(prefix="lotweave-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends there, and lost executors lose nothing.

    The table goes when the driver's process ends, or earlier if it was written within scratch().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lotweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _collect[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(tables: list):
    """durable()'s tables are listed in `tables` meanwhile; those that are in it already go first."""
    _remove(tables)
    if not any(x is tables for x in _scratches):
        _scratches.append(tables)
    _collect.append(tables)
    try:
        yield
    finally:
        _collect.pop()


def remove_durable() -> None:
    """Removes all tables that durable() wrote; results that still read them can't be used afterwards."""
    for tables in (_written, *_scratches):
        _remove(tables)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM has gone already
            return


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, whatever folder they start in, and get texts in small batches."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    now = spark.conf.get(ARROW_BATCH).rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES or int(now) <= 0:
        spark.conf.set(ARROW_BATCH, f"{ARROW_BYTES}b")


atexit.register(remove_durable)


def release() -> None:
    """Gives a worker's freed memory back, so that what one batch needed isn't held while others run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `limit` bytes of text; a single longer text is a run of its own."""
    texts = batch.column(column)
    if pa.types.is_primitive(texts.type):
        size = np.full(len(texts), 8, np.int64)
    else:
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends, start, total = np.cumsum(size), 0, 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, total + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, total = stop, int(ends[stop - 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and the offsets of each; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_texts(df: DataFrame, key: str, text: str, work: Callable[[pa.Array, pa.Array], Iterator[pa.RecordBatch]], schema: str, extra: tuple[str, ...] = (), limit: int = BATCH_BYTES) -> DataFrame:
    """Runs work(keys, texts, *extra) over bounded runs of rows; the columns it needs are chosen first, so others can't clash."""
    importable(df.sparkSession)
    chosen = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=limit):
                yield from work(*part.columns)
                release()

    return chosen.mapInArrow(run, schema)
