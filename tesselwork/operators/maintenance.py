"""Reachability, garbage collection, expiration and storage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import history


def reachable(snapshots: DataFrame, refs: DataFrame) -> DataFrame:
    """Snapshots that a branch or tag leads to."""
    return history.ancestry(snapshots, refs).select("snapshot_id").distinct()


def orphans(objects: DataFrame, retained: DataFrame, cutoff) -> DataFrame:
    """Objects (kind, id, created_at, size_bytes) that nothing retains and that are older than
    the cutoff (exclusive)."""
    return objects.where(F.col("created_at") < F.lit(cutoff)).join(retained, ["kind", "id"], "left_anti")


def gc_summary(gone: DataFrame) -> DataFrame:
    return gone.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def expire(snapshots: DataFrame, refs: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(released, kept): released snapshots are older than the cutoff (exclusive), have a
    parent and are no tip; kept ones come with new_parent: the root if their chain lost one."""
    old = snapshots.where((F.col("flushed_at") < F.lit(cutoff)) & F.col("parent_id").isNotNull())
    released = old.join(refs.select("snapshot_id"), "snapshot_id", "left_anti")
    kept = snapshots.join(released.select("snapshot_id"), "snapshot_id", "left_anti")
    gone = released.select(F.col("snapshot_id").alias("_gone"))
    roots = history.ancestry(snapshots, kept.where("parent_id is not null")).groupBy("start").agg(F.max_by("snapshot_id", "depth").alias("root")).select(F.col("start").alias("snapshot_id"), "root")
    lost = kept.join(gone, kept.parent_id == gone["_gone"], "left").join(roots, "snapshot_id", "left")
    return released, lost.select("snapshot_id", F.when(F.col("_gone").isNull(), F.col("parent_id")).otherwise(F.col("root")).alias("new_parent"))


def storage_stats(refs: DataFrame) -> DataFrame:
    """(kind, bytes): native chunks once by chunk id, virtual ones once by place, inline ones
    every time.  refs: (kind, chunk_id, location, offset, length), 1 native, 2 virtual, 3 inline."""
    native = refs.where("kind = 1").groupBy("chunk_id").agg(F.max("length").alias("length")).select(F.lit("native").alias("kind"), "length")
    virtual = refs.where("kind = 2").select("location", "offset", "length").distinct().select(F.lit("virtual").alias("kind"), "length")
    inline = refs.where("kind = 3").select(F.lit("inline").alias("kind"), "length")
    return native.unionByName(virtual).unionByName(inline).groupBy("kind").agg(F.sum("length").cast("bigint").alias("bytes"))
