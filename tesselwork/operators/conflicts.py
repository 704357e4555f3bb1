"""Conflicts between a session's changes and a commit made meanwhile, and their resolution.

Every check is a join of two change tables on node or (node, coord); both are spread by the
key, so a commit of many chunks is compared where its rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

KINDS = (
    "move_cannot_be_rebased", "new_node_conflicts_with_existing", "new_node_in_invalid_group", "metadata_double_update", "metadata_update_of_deleted_array", "metadata_update_of_deleted_group",
    "chunks_updated_in_deleted_array", "chunks_updated_in_updated_array", "chunk_double_update", "delete_of_updated_array", "delete_of_updated_group",
)


def double_updated_chunks(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(node_id, coord) of the chunks that both sides wrote."""
    return ours.select("node_id", "coord").distinct().join(theirs.select("node_id", "coord").distinct(), ["node_id", "coord"], "left_semi")


def chunk_double_updates(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(node_id, n) of the nodes with chunks that both sides wrote."""
    return double_updated_chunks(ours, theirs).groupBy("node_id").agg(F.count("*").alias("n"))


def new_in_array(new_paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """New paths with an array among their ancestors."""
    arrays = nodes.where("node_type = 'array'").select(F.col("path").alias("above"))
    return new_paths.select("path", F.explode(paths.ancestors(F.col("path"))).alias("above")).join(arrays, "above", "left_semi").select("path").distinct()


def detect(ours_nodes: DataFrame, ours_chunks: DataFrame, theirs_nodes: DataFrame, theirs_chunks: DataFrame, theirs_moves: DataFrame, tree: DataFrame) -> DataFrame:
    """(kind, path, node_id, n) of all conflicts.

    ours_nodes, theirs_nodes: (change new|updated|deleted, node_id, path, node_type);
    ours_chunks, theirs_chunks: (node_id, coord); theirs_moves: any rows; tree: (path, node_id,
    node_type) after their commit."""

    def ours(change: str, kind: str | None = None) -> DataFrame:
        df = ours_nodes.where(F.col("change") == change)
        return df.where(F.col("node_type") == kind) if kind else df

    def theirs(change: str, kind: str | None = None) -> DataFrame:
        df = theirs_nodes.where(F.col("change") == change)
        return (df.where(F.col("node_type") == kind) if kind else df).select("node_id").distinct()

    def found(kind: str, df: DataFrame, n=None) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col("path"), F.col("node_id"), (F.lit(1) if n is None else n).cast("bigint").alias("n"))

    named = tree.select("node_id", "path")
    touched = ours_chunks.select("node_id").distinct().join(named, "node_id")
    recreated = ours("deleted").select("path")
    wrote = theirs_chunks.select("node_id").distinct()
    fresh = ours("new").join(recreated, "path", "left_anti")
    doubles = chunk_double_updates(ours_chunks, theirs_chunks).join(named, "node_id")
    out = [
        found(KINDS[1], fresh.join(tree.select("path"), "path", "left_semi")),
        found(KINDS[2], ours("new").join(new_in_array(ours("new"), tree), "path", "left_semi")),
        found(KINDS[3], ours("updated").join(theirs("updated"), "node_id", "left_semi")),
        found(KINDS[4], ours("updated", "array").join(theirs("deleted", "array"), "node_id", "left_semi")),
        found(KINDS[5], ours("updated", "group").join(theirs("deleted", "group"), "node_id", "left_semi")),
        found(KINDS[6], ours_chunks.select("node_id").distinct().join(theirs_nodes.where("change = 'deleted' and node_type = 'array'").select("node_id", "path").distinct(), "node_id")),
        found(KINDS[7], touched.join(theirs("updated", "array"), "node_id", "left_semi")),
        found(KINDS[8], doubles, F.col("n")),
        found(KINDS[9], ours("deleted", "array").join(theirs("updated", "array").union(wrote).distinct(), "node_id", "left_semi")),
        found(KINDS[10], ours("deleted", "group").join(theirs("updated", "group"), "node_id", "left_semi")),
    ]
    whole = found(KINDS[0], theirs_moves.limit(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("node_id")))
    for df in out:
        whole = whole.unionByName(df)
    return whole


def use_theirs(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Our chunk changes without those they also made."""
    return ours.join(theirs.select("node_id", "coord").distinct(), ["node_id", "coord"], "left_anti")
