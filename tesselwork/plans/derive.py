"""Catalogue tables derived from the driver's tables by fixed rules, so that every operator
has an input that SQL can derive too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that one task groups, about; a group takes some hundred bytes, twice.
ROWS_A_TASK = 1_250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in so many partitions by keys that a task gets ROWS_A_TASK rows, about.

    For aggregates of nearly as many groups as rows: adaptive execution joins partitions by
    their compressed bytes and by the number of cores, whatever the groups they hold then take."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_A_TASK + 1)
    return df.repartition(n, *keys)


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def coord_text(coord: F.Column) -> F.Column:
    return F.array_join(coord.cast("array<string>"), "/")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, path, node_type): regions are groups below the root, nations arrays in them."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    groups = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.concat(F.lit("/"), "r_name").alias("path"), F.lit("group").alias("node_type"))
    arrays = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"), F.lit("array").alias("node_type"))
    return groups.unionByName(arrays)


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, coord, ts, payload, length, deleted): events as chunk writes, errors as tombstones."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("kind"), F.pmod("user_id", F.lit(7)).cast("string").alias("node"), F.array(F.floor(F.col("user_id") / 10).cast("bigint"), F.pmod("user_id", F.lit(10)).cast("bigint")).alias("coord"), "ts", big("event_id").alias("payload"), (F.pmod("event_id", F.lit(97)) + 1).cast("bigint").alias("length"), (F.col("event_type") == "error").alias("deleted")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, parent_id, flushed_at): one a day of events, on the day before."""
    e = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("snapshot_id")).agg(F.max("ts").alias("flushed_at"))
    from pyspark.sql import Window

    return e.select("snapshot_id", F.lag("snapshot_id").over(Window.orderBy("snapshot_id")).alias("parent_id"), "flushed_at")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, name, snapshot_id): main at the newest snapshot, a branch and two tags before it."""
    s = snapshots(spark, sf_dir)
    found = s.agg(F.max("snapshot_id").alias("a"), F.array_sort(F.collect_list("snapshot_id")).alias("l"))
    at = lambda i: F.element_at("l", i)
    return found.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), i.alias("snapshot_id")) for k, n, i in (("branch", "main", F.col("a")), ("branch", "dev", at(20)), ("tag", "v1", at(5)), ("tag", "v2", at(10)))])).alias("r")
    ).select("r.*")


def chunk_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, coord, length, kind): line items, one chunk a coordinate."""
    li = read(spark, sf_dir, "lineitem")
    keyed = li.select("l_suppkey", F.floor(F.col("l_orderkey") / 1000).cast("bigint").alias("a"), big("l_linenumber").alias("b"), big("l_quantity").alias("q"), "l_returnflag")
    chunks = dealt(keyed, "l_suppkey", "a", "b").groupBy("l_suppkey", "a", "b").agg(F.sum("q").alias("length"), F.max("l_returnflag").alias("flag"))
    return chunks.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node"), F.array("a", "b").alias("coord"), "length", F.when(F.col("flag") == "A", 1).when(F.col("flag") == "N", 2).otherwise(3).alias("kind"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunk changes of two sessions: urgent and high orders against the others, by customer."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("n"), F.pmod("o_custkey", F.lit(25)).cast("string")).alias("node_id"), F.array(big("o_custkey")).alias("coord"), "o_orderpriority", "o_orderkey")
    ours = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    return o.where(ours), o.where(~ours)
