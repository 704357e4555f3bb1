"""Shared plumbing: durable intermediate tables, connected components, batch limits."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, at most (a longer text travels alone).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches so small that a worker never holds more than BATCH_ROWS texts or
    BATCH_BYTES and one text at a time.  Lowers two limits of the session, and leaves lower
    ones as they are: plans are run after the operator returns, so they cannot be put back."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower()
        limit = int(now.removesuffix("b")) if re.fullmatch(r"-?\d+b?", now) else most + 1
        if limit <= 0 or limit > most:
            spark.conf.set(key, str(most))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what its allocators hold: workers outlive their
    tasks, and what idle ones keep counts against the executor."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return lean_run


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or on a local master, as in tests,
    a fresh folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesselwork-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may already have ended; the folder is then left to its owner
        pass


_registered: set[str] = set()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends here, and
    the table outlives any executor."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tesselwork-{spark.sparkContext.applicationId}"
    if root not in _registered:
        _registered.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that no plan reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._written_to)


def in_ranges(df: DataFrame, order: list, tag: str) -> DataFrame:
    """df sorted into ranges of the given order and written out, with _part, the number of a
    row's range: rows of a lower range stand before those of a higher one, and one key's rows
    may lie in many ranges."""
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), tag)


def lines_without(lines: str, gone: str) -> F.Column:
    """The text of an array of lines without those whose numbers gone holds, in order: the
    stretches between them are joined."""
    begins = F.concat(F.array(F.lit(0)), F.transform(F.col(gone), lambda i: i + 1))
    ends = F.concat(F.col(gone), F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(lines, b + 1, e - b))), "\n")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced: the first
    round frees the plans, the second what only they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a, b), by alternating large and small stars,
    in as many rounds as it takes (about the logarithm of the longest path).

    Returns (node, component), component being the smallest node reachable, for every node
    of an edge between different nodes.  Per-node minima are aggregated with a map-side
    combine; in the joins a hub meets one row, so adaptive execution splits its edges over
    tasks.  Each round is written out and the one before deleted.  Null ends and self loops
    are ignored."""
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag
    )
    seen = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, e = e, materialize(small.union(least).distinct(), tag)
        discard(last)
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
