"""Snapshots, references and transaction logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Snapshots up to which a parent chain is followed on the driver (about 50 bytes each).
DRIVER_SNAPSHOTS = 100_000


def ancestry(snapshots: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, snapshot_id, depth) of the parent chain of each start, itself at depth 0.

    Up to DRIVER_SNAPSHOTS the parents are followed on the driver, as the commit log does,
    beyond that by pointers that double their reach."""
    spark = snapshots.sparkSession
    parents = snapshots.select("snapshot_id", "parent_id").limit(DRIVER_SNAPSHOTS + 1).collect()
    if len(parents) > DRIVER_SNAPSHOTS:
        return ancestry_by_doubling(snapshots, starts)
    up = {r.snapshot_id: r.parent_id for r in parents}
    found = []
    for (start,) in starts.select("snapshot_id").distinct().collect():
        at, depth = start, 0
        while at is not None:
            found.append((start, at, depth))
            at, depth = up.get(at), depth + 1
    return spark.createDataFrame(found, "start string, snapshot_id string, depth int")


def ancestry_by_doubling(snapshots: DataFrame, starts: DataFrame) -> DataFrame:
    """The same in a logarithmic number of joins: after k rounds chains hold 2**k snapshots and
    pointers reach that far.  Each round is kept until the next one stands on it."""
    jump = snapshots.select(F.col("snapshot_id").alias("id"), F.col("parent_id").alias("to")).where("to is not null").persist()
    reached = starts.select(F.col("snapshot_id").alias("start"), "snapshot_id", F.lit(0).alias("depth")).distinct().persist()
    step, kept = 1, [jump, reached]
    while True:
        further = reached.join(jump, reached.snapshot_id == jump.id).select("start", F.col("to").alias("snapshot_id"), (F.col("depth") + step).alias("depth"))
        reached = reached.union(further).persist()
        kept.append(reached)
        after = jump.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        jump = jump.join(after, F.col("to") == F.col("_id")).select("id", F.col("_to").alias("to")).persist()
        kept.append(jump)
        reached.count()
        if jump.isEmpty():
            for df in kept[:-2]:
                df.unpersist()
            return reached
        step *= 2


def resolve_as_of(snapshots: DataFrame, tip: DataFrame, at) -> DataFrame:
    """The first snapshot of the tip's ancestry written at or before a time (no row if none)."""
    chain = ancestry(snapshots, tip).join(snapshots.select("snapshot_id", "flushed_at"), "snapshot_id")
    return chain.where(F.col("flushed_at") <= F.lit(at)).groupBy("start").agg(F.min_by("snapshot_id", "depth").alias("snapshot_id"))


def diff_nodes(tx: DataFrame, chain: DataFrame, paths: DataFrame) -> DataFrame:
    """(change, path): the node changes logged by the snapshots of a chain.  Logs are united
    without cancelling; a node in neither end tree has no path and is left out."""
    return tx.join(chain.select("snapshot_id"), "snapshot_id", "left_semi").select("change", "node_id").distinct().join(paths, "node_id").select("change", "path")


def diff_chunks(tx: DataFrame, chain: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, coord) of the chunks that the snapshots of a chain changed."""
    return tx.join(chain.select("snapshot_id"), "snapshot_id", "left_semi").select("node_id", "coord").distinct().join(paths, "node_id").select("path", "coord")


def collapse_moves(moves: DataFrame) -> DataFrame:
    """One move a node: from its first place to its last; nodes that came back are left out."""
    ends = moves.groupBy("node_id").agg(F.min_by("from_path", "ordinal").alias("from_path"), F.max_by("to_path", "ordinal").alias("to_path"))
    return ends.where("from_path <> to_path")


def merged_log(first: DataFrame, second: DataFrame) -> DataFrame:
    """The log of a commit amended by another: both, once."""
    return first.unionByName(second).distinct()
