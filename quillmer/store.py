"""Tables that an operator or a session writes once and reads again, under the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: list[str] = []
_LOCK, _WRITERS = threading.Lock(), [0, None]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="quillmer-core-"))
    return _OWN[0]


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a finished plan while any writer is inside; then as before."""
    with _LOCK:
        if not _WRITERS[0]:
            _WRITERS[1] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _WRITERS[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS[0] -= 1
            if not _WRITERS[0]:
                spark.conf.unset(_CLEANUP) if _WRITERS[1] is None else spark.conf.set(_CLEANUP, _WRITERS[1])


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet, and a reader of it; its plan's shuffle files go at once, the folder by ``dropped`` or at the end of the driver's JVM."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with _cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    out.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(out)
    read = spark.read.schema(df.schema).parquet(path)
    read._quillmer_path = path
    return read


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._quillmer_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
