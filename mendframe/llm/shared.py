"""What the operators of this package share: the shared folder, materialised tables, word counts."""
from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
ARROW_BATCH_BYTES = 4 << 20
SLICE_BYTES = 2 << 20
SLICE_ROWS = 10_000
MMAP_THRESHOLD, LARGE_ARRAY = -3, 2 << 20  # M_MMAP_THRESHOLD of the C library's mallopt


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="mendframe-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def sweep() -> None:
    """Deletes the folders that this driver has made; results are read from them until then."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here and any executor can reread it.

    The folder is deleted when the driver ends.
    """
    path = fresh_path(df.sparkSession, kind)
    _made.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = ARROW_BATCH_BYTES) -> None:
    """Bounds Arrow batches by bytes, so that long texts don't pile up in a Python worker.

    Plans read the setting when they run, so it stays for the session; a smaller one is kept.
    """
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if not (now or "").isdigit() or not 0 < int(now) <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def tidied(run: Callable) -> Callable:
    """run for mapInArrow(); the Python worker, which lives on, gives freed memory back to the system.

    Large arrays go back as they are freed, the rest at the end of the task.
    """

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).mallopt(MMAP_THRESHOLD, LARGE_ARRAY)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return inner


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some bytes of text and so many rows at most: what a text needs in arrays is many times the text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    before, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + rows, int(np.searchsorted(before, before[at] + SLICE_BYTES)) - 1))
        yield batch.slice(at, to - at)
        at = to


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a plan's size; 0 where it knows none, which reads as the largest long."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def own_name(df: DataFrame, name: str) -> str:
    """A helper column name that df doesn't use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
