"""The overlay scan and its relatives: committed chunks below uncommitted changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

KEYS = ("node", "coord")


def latest(writes: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "ts") -> DataFrame:
    """The last write of each key.  An aggregate of one struct: combined before the shuffle."""
    rest = [c for c in writes.columns if c not in keys and c != order]
    last = writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("w"), F.max(order).alias(order))
    return last.select(*keys, "w.*", order)


def live(base: DataFrame, delta: DataFrame, keys: tuple[str, ...] = KEYS, gone: str = "deleted") -> DataFrame:
    """base with delta laid over it: delta's rows that are not tombstones, and base's rows whose
    key delta does not hold.  delta has one row a key."""
    kept = base.join(delta.select(*keys), list(keys), "left_anti")
    return delta.where(~F.col(gone)).drop(gone).unionByName(kept.drop(gone) if gone in kept.columns else kept)


def live_as_of(writes: DataFrame, at, keys: tuple[str, ...] = KEYS, order: str = "ts", gone: str = "deleted") -> DataFrame:
    """Live keys counting the writes up to and including a time."""
    return latest(writes.where(F.col(order) <= F.lit(at)), keys, order).where(~F.col(gone)).drop(gone)


def merge_sessions(deltas: list[DataFrame], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Changes of several sessions as one, the later session winning a key."""
    tagged = [d.withColumn("ordinal", F.lit(i)) for i, d in enumerate(deltas)]
    whole = tagged[0]
    for d in tagged[1:]:
        whole = whole.unionByName(d)
    return latest(whole, keys, "ordinal")


def longest_prefix(rows: DataFrame, location: str, containers: DataFrame) -> DataFrame:
    """rows with the container (name) whose url_prefix is the longest that starts the location.

    Prefixes meet rows by equality: each location offers its prefixes of the lengths that
    occur, so the join is a hash join however many containers there are."""
    lengths = [r[0] for r in containers.select(F.length("url_prefix")).distinct().collect()]
    offered = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_p", F.array_distinct(F.array(*[F.substring(location, 1, n) for n in lengths])) if lengths else F.array().cast("array<string>"))
    small = containers.select(F.col("name").alias("container"), F.col("url_prefix").alias("_prefix"))
    met = offered.select("_row", F.explode("_p").alias("_prefix")).join(small, "_prefix")
    best = met.groupBy("_row").agg(F.max_by("container", F.length("_prefix")).alias("container"))
    return offered.join(best, "_row", "left").drop("_row", "_p")


def expand_alias(location: Column, containers: dict[str, str]) -> Column:
    """vcc://name/rest as the container's prefix and rest; other locations as they are."""
    name, rest = F.regexp_extract(location, r"^vcc://([^/]+)/(.*)$", 1), F.regexp_extract(location, r"^vcc://([^/]+)/(.*)$", 2)
    prefix = F.lit(None).cast("string")
    for k, v in containers.items():
        prefix = F.when(name == k, F.lit(v)).otherwise(prefix)
    return F.when(name == "", location).otherwise(F.concat(prefix, rest))


def numbered(df: DataFrame, order: list[Column], keys: tuple[str, ...]) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def get_many(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """keys: (key, ...) joined to chunks: (path, coord, ...) on what the key says, in one
    shuffle of each side by path and first indices; keys that name no live chunk are left out."""
    # coalesce keeps the parser out of filters that would run it again below the join
    parsed = keys.withColumn("_p", paths.parse_key(F.col("key"))).withColumns({"_path": F.coalesce("_p.path", F.lit("")), "_at": F.coalesce(F.array_join(F.col("_p.coord").cast("array<string>"), "/"), F.lit("?"))}).drop("_p")
    c = chunks.withColumns({"_c_path": F.col("path"), "_c_at": F.array_join(F.col("coord").cast("array<string>"), "/")})
    return parsed.join(c, (F.col("_path") == F.col("_c_path")) & (F.col("_at") == F.col("_c_at"))).drop("_path", "_at", "_c_path", "_c_at")


def closest_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(wanted, path, node_type): for each wanted path the node there or the nearest above it;
    paths without any are left out."""
    above = wanted.select("wanted", F.explode(F.concat(F.array("wanted"), paths.ancestors(F.col("wanted")))).alias("path"))
    found = above.join(nodes.select("path", "node_type"), "path").groupBy("wanted").agg(F.max_by(F.struct("path", "node_type"), F.length("path")).alias("n"))
    return found.select("wanted", "n.path", "n.node_type")
