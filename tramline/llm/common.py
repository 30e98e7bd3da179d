"""What several operators of this folder share: written intermediate tables and bounded Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bounds of an Arrow batch, the same for every operator, so that a lazy result has them whenever it runs: bytes for whole
#: texts (a batch is over by one row at most), rows for short ones.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 50_000


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="tramline-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``; where that is unset, an own one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or _own_dir()).rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tramline/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them can't be computed after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tramline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that survive the loss of executors, and gives Catalyst the real size, so that a join
    with it is broadcast only if that size is under ``spark.sql.autoBroadcastJoinThreshold``. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run):
    """``run`` over Arrow batches, and when its task ends, free memory goes back to the system: workers outlive many tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def put_file(base: str, name: str, raw: bytes) -> None:
    """Write whole, then rename: a task that runs twice writes the same bytes under the same name."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(base)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(part) as f:
        f.write(raw)
    store.move(part, f"{root}/{name}")
