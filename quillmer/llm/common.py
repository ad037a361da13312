"""What the training-data operators share: table access, scratch tables, connected components.

Scratch tables replace lineage: a stage that is read more than once is written
as Parquet under ``spark.checkpoint.dir`` (shared by driver and executors), so
losing an executor costs a re-read and not a recomputation. What a run still holds
when the driver ends is deleted then.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank characters that separate words: space and the ASCII controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one Parquet table; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="quillmer-"))
    return _OWN_DIR[0]


_LOCK, _WRITERS = threading.Lock(), [0, None]


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Spark's own removal of a finished plan's shuffle files, on while any writer is inside, then as before."""
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


class Scratch:
    """Tables of one operator run, written once and read as often as needed.

    Results are lazy, so tables that a result reads must outlive the run; the run's
    folder is deleted when the driver's file system closes, at the end of the
    session's JVM. Tables that nothing reads any more are dropped at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return a reader of what was written; the shuffle files of its plan are done with."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with shuffle_cleanup(self.spark):
            df.write.parquet(path)
        schema = df.schema
        out = self.spark.read.schema(schema).parquet(path)
        out._quillmer_path = path
        return out

    def drop(self, kept: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(kept._quillmer_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no operator may learn from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def words(text: Column) -> Column:
    """Maximal runs of non-blank characters; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row.

    Catalyst may inline a projected column wherever a lambda refers to it and so
    compute it anew for every element; a lambda variable is bound once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable.

    Alternates large-star and small-star passes, each an aggregate and a join on
    the node, until the set of links no longer changes (a logarithmic number of
    passes). Joins carry many rows against one row a key, and both sides are plain
    shuffles, so a hot node is split by adaptive execution. Nothing but two numbers a pass reaches the driver.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        low = scratch.keep(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
        moved = near.where("b > a") if large else near
        out = moved.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select("a", F.col("m").alias("b")))
        out = scratch.keep(out.where("a <> b").distinct(), "large" if large else "small")
        scratch.drop(low)
        scratch.drop(e)
        return out

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = scratch.keep(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    before = mark(edges)
    while before[0]:
        edges = star(star(edges, True), False)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
