"""Every query of the array catalogue by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grids, paths
from ..operators import arrays, conflicts, history, maintenance, overlay
from . import derive
from .derive import big, coord_text, read

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# Parts of the SQL that several queries share.
WRITES = "writes AS (SELECT cast(user_id % 7 AS varchar) AS node, cast(user_id // 10 AS varchar) || '/' || cast(user_id % 10 AS varchar) AS coord, ts, event_id AS payload, event_id % 97 + 1 AS length, event_type = 'error' AS deleted FROM events)"
SNAPSHOTS = "days AS (SELECT strftime(ts, '%Y%m%d') AS snapshot_id, max(ts) AS flushed_at FROM events GROUP BY 1), snapshots AS (SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS parent_id, flushed_at, row_number() OVER (ORDER BY snapshot_id) AS n FROM days)"
REFS = SNAPSHOTS + ", refs AS (SELECT 'branch' AS kind, 'main' AS name, max(snapshot_id) AS snapshot_id FROM snapshots UNION ALL SELECT 'branch', 'dev', snapshot_id FROM snapshots WHERE n = 20 UNION ALL SELECT 'tag', 'v1', snapshot_id FROM snapshots WHERE n = 5 UNION ALL SELECT 'tag', 'v2', snapshot_id FROM snapshots WHERE n = 10)"
NODES = "nodes AS (SELECT 'r' || cast(r_regionkey AS varchar) AS node_id, '/' || r_name AS path, 'group' AS node_type FROM region UNION ALL SELECT 'n' || cast(n_nationkey AS varchar), '/' || r_name || '/' || n_name, 'array' FROM nation JOIN region ON n_regionkey = r_regionkey)"
CHUNKS = "chunks AS (SELECT 's' || cast(l_suppkey AS varchar) AS node, l_orderkey // 1000 AS a, l_linenumber AS b, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS length, CASE max(l_returnflag) WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS kind FROM lineitem GROUP BY 1, 2, 3)"
SIDES = "o AS (SELECT 'n' || cast(o_custkey % 25 AS varchar) AS node_id, o_custkey AS coord, o_orderkey, substr(o_orderpriority, 1, 1) IN ('1', '2') AS is_ours FROM orders), ours AS (SELECT * FROM o WHERE is_ours), theirs AS (SELECT * FROM o WHERE NOT is_ours)"


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _live_sql(where: str, name: str = "live") -> str:
    return f"ranked_{name} AS (SELECT *, row_number() OVER (PARTITION BY node, coord ORDER BY ts DESC) AS r FROM writes WHERE {where}), {name} AS (SELECT * FROM ranked_{name} WHERE r = 1)"


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("coord", coord_text(F.col("coord")))


# chunk scans and the store's view


@query(f"WITH {WRITES}, {_live_sql("ts <= TIMESTAMP '2024-01-20 00:00:00'")} SELECT node, coord, payload, length FROM live WHERE NOT deleted")
def as_of_live_chunks(spark, sf_dir):
    w = derive.writes(spark, sf_dir).drop("kind")
    return _text(overlay.live_as_of(w, _time("2024-01-20"))).select("node", "coord", "payload", "length")


def _time(text: str):
    from datetime import datetime

    return datetime.fromisoformat(text)


def _overlay(spark, sf_dir):
    w = derive.writes(spark, sf_dir).drop("kind")
    base = overlay.live_as_of(w, _time("2024-01-15"))
    delta = overlay.latest(w.where((F.col("ts") > F.lit(_time("2024-01-15"))) & (F.col("ts") <= F.lit(_time("2024-01-18")))), order="ts")
    return overlay.live(base, delta)


_OVERLAY = f"{WRITES}, {_live_sql("ts <= TIMESTAMP '2024-01-15 00:00:00'", 'base')}, {_live_sql("ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-18 00:00:00'", 'delta')}, scan AS (SELECT node, coord, payload, length FROM delta WHERE NOT deleted UNION ALL SELECT b.node, b.coord, b.payload, b.length FROM base b LEFT JOIN delta d ON d.node = b.node AND d.coord = b.coord WHERE NOT b.deleted AND d.node IS NULL)"


@query(f"WITH {_OVERLAY} SELECT node, coord, payload, length FROM scan")
def overlay_scan(spark, sf_dir):
    return _text(_overlay(spark, sf_dir)).select("node", "coord", "payload", "length")


@query(f"WITH {_OVERLAY} SELECT node, coord FROM scan WHERE node = '3'")
def chunk_coordinates(spark, sf_dir):
    return _text(_overlay(spark, sf_dir).where("node = '3'")).select("node", "coord").distinct()


@query(f"WITH {CHUNKS}, wanted AS (SELECT 's' || cast(s_suppkey AS varchar) AS node, s_suppkey % 15 AS a, 1 AS b FROM supplier) SELECT w.node, cast(w.a AS bigint) AS a, cast(coalesce(c.kind, 0) AS integer) AS kind FROM wanted w LEFT JOIN chunks c ON c.node = w.node AND c.a = w.a AND c.b = w.b")
def chunk_type(spark, sf_dir):
    c = derive.chunk_refs(spark, sf_dir)
    wanted = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.pmod("s_suppkey", F.lit(15)).cast("bigint").alias("a")).withColumn("coord", F.array("a", F.lit(1).cast("bigint")))
    return wanted.join(c, ["node", "coord"], "left").select("node", "a", F.coalesce("kind", F.lit(0)).alias("kind"))


@query(f"WITH {CHUNKS} SELECT node || '/zarr.json' AS key FROM (SELECT DISTINCT node FROM chunks) t WHERE node = 's7' OR node = 's8' UNION ALL SELECT node || '/c/' || cast(a AS varchar) || '/' || cast(b AS varchar) FROM chunks WHERE node = 's7' OR node = 's8'")
def list_prefix(spark, sf_dir):
    c = derive.chunk_refs(spark, sf_dir).withColumn("path", F.concat(F.lit("/"), "node")).where(paths.under(F.col("path"), "/s7") | paths.under(F.col("path"), "/s8"))
    meta = c.select("path").distinct().select(paths.metadata_key(F.col("path")).alias("key"))
    return meta.union(c.select(paths.chunk_key(F.col("path"), F.col("coord"))))


@query(f"WITH {NODES} SELECT DISTINCT split_part(substr(path, 2), '/', 1) AS item, 'prefix' AS kind FROM nodes")
def list_dir(spark, sf_dir):
    keys = derive.nodes(spark, sf_dir).select(paths.metadata_key(F.col("path")).alias("key"))
    return keys.select(F.split("key", "/")[0].alias("item"), F.when(F.contains("key", F.lit("/")), "prefix").otherwise("key").alias("kind")).distinct()


@query(f"WITH {CHUNKS} SELECT node, cast(sum(length) AS bigint) AS bytes, count(*) AS n FROM chunks GROUP BY node")
def getsize_prefix(spark, sf_dir):
    return derive.chunk_refs(spark, sf_dir).groupBy("node").agg(F.sum("length").alias("bytes"), F.count("*").alias("n"))


@query(f"WITH {NODES} SELECT path, node_type FROM nodes WHERE path = '/ASIA' OR path LIKE '/ASIA/%'")
def list_nodes(spark, sf_dir):
    return derive.nodes(spark, sf_dir).where(paths.under(F.col("path"), "/ASIA")).select("path", "node_type")


@query(f"WITH {NODES}, everything AS (SELECT * FROM nodes UNION ALL SELECT 'root', '/', 'group'), wanted AS (SELECT path || '/x/y' AS wanted, path AS closest FROM nodes UNION ALL SELECT path, path FROM nodes UNION ALL SELECT path || 'x', CASE WHEN node_type = 'group' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END FROM nodes) SELECT wanted, closest, e.node_type FROM wanted JOIN everything e ON e.path = closest")
def closest_ancestor(spark, sf_dir):
    n = derive.nodes(spark, sf_dir).select("path", "node_type")
    n = n.union(spark.range(1).select(F.lit("/"), F.lit("group")))
    named = n.where("path <> '/'")
    wanted = named.select(F.explode(F.array(F.concat("path", F.lit("/x/y")), F.col("path"), F.concat("path", F.lit("x")))).alias("wanted"))
    return overlay.closest_nodes(wanted, n).select("wanted", F.col("path").alias("closest"), "node_type")


@query("WITH k AS (SELECT 'a/b' || cast(n_nationkey AS varchar) AS p, cast(n_regionkey AS varchar) AS r FROM nation), keys AS (SELECT p || '/c/' || r || '/2' AS key, 'chunk' AS kind, '/' || p AS path, r || '/2' AS coord FROM k UNION ALL SELECT p || '/zarr.json', 'metadata', '/' || p, NULL FROM k UNION ALL SELECT p || '/c/x/c/' || r, 'chunk', '/' || p || '/c/x', r FROM k UNION ALL SELECT p || '/c', 'chunk', '/' || p, '' FROM k UNION ALL SELECT p || '/' || r, 'unknown', NULL, NULL FROM k UNION ALL SELECT p || '/c/1x', 'unknown', NULL, NULL FROM k UNION ALL SELECT 'c/' || p || '/zarr.json2', 'unknown', NULL, NULL FROM k) SELECT * FROM keys UNION ALL SELECT 'zarr.json', 'metadata', '/', NULL UNION ALL SELECT 'c/0', 'chunk', '/', '0'")
def parse_keys(spark, sf_dir):
    p, r = F.concat(F.lit("a/b"), F.col("n_nationkey").cast("string")), F.col("n_regionkey").cast("string")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    several = F.array(cat(p, "/c/", r, "/2"), cat(p, "/zarr.json"), cat(p, "/c/x/c/", r), cat(p, "/c"), cat(p, "/", r), cat(p, "/c/1x"), cat("c/", p, "/zarr.json2"))
    keys = read(spark, sf_dir, "nation").select(F.explode(several).alias("key"))
    keys = keys.union(spark.range(1).select(F.explode(F.array(F.lit("zarr.json"), F.lit("c/0")))))
    return _text(keys.select("key", paths.parse_key(F.col("key")).alias("p")).select("key", "p.*"))


@query(f"WITH {CHUNKS}, wanted AS (SELECT 's' || cast(l_suppkey AS varchar) AS node, l_orderkey // 1000 AS a, l_linenumber AS b, max(l_partkey) AS pos FROM lineitem GROUP BY 1, 2, 3) SELECT c.node || '/c/' || cast(c.a AS varchar) || '/' || cast(c.b AS varchar) AS key, w.pos, c.length FROM wanted w JOIN chunks c ON c.node = w.node AND c.a = w.a AND c.b = w.b")
def multi_get(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", grids.div(F.col("l_orderkey"), 1000).alias("a"), "l_linenumber", "l_partkey")
    asked = derive.dealt(li, "l_suppkey", "a", "l_linenumber").groupBy("l_suppkey", "a", "l_linenumber").agg(F.max("l_partkey").alias("pos"))
    keys = asked.select(F.concat_ws("/", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.lit("c"), F.col("a").cast("string"), F.col("l_linenumber").cast("string")).alias("key"), "pos")
    return overlay.get_many(keys, derive.chunk_refs(spark, sf_dir).withColumn("path", F.concat(F.lit("/"), "node")).drop("node")).select("key", "pos", "length")


# history


@query(f"WITH RECURSIVE {SNAPSHOTS}, chain(snapshot_id, depth) AS (SELECT max(snapshot_id), 0 FROM snapshots UNION ALL SELECT s.parent_id, c.depth + 1 FROM chain c JOIN snapshots s ON s.snapshot_id = c.snapshot_id WHERE s.parent_id IS NOT NULL) SELECT snapshot_id, depth FROM chain")
def ancestry(spark, sf_dir):
    s = derive.snapshots(spark, sf_dir)
    return history.ancestry(s, s.agg(F.max("snapshot_id").alias("snapshot_id"))).select("snapshot_id", "depth")


@query(f"WITH {REFS} SELECT r.name, s.snapshot_id, cast(t.n - s.n AS integer) AS depth FROM refs r JOIN snapshots t ON t.snapshot_id = r.snapshot_id JOIN snapshots s ON s.n <= t.n")
def ancestry_with_refs(spark, sf_dir):
    s, r = derive.snapshots(spark, sf_dir), derive.refs(spark, sf_dir)
    return history.ancestry(s, r).join(r.select("name", F.col("snapshot_id").alias("start")), "start").select("name", "snapshot_id", "depth")


@query(f"WITH {REFS} SELECT name, snapshot_id FROM refs WHERE kind = 'tag'")
def resolve_tag(spark, sf_dir):
    return derive.refs(spark, sf_dir).where("kind = 'tag'").select("name", "snapshot_id")


@query(f"WITH {REFS} SELECT max(snapshot_id) AS snapshot_id FROM snapshots WHERE flushed_at <= TIMESTAMP '2024-01-12 12:00:00'")
def resolve_as_of(spark, sf_dir):
    tip = derive.refs(spark, sf_dir).where("name = 'main'")
    return history.resolve_as_of(derive.snapshots(spark, sf_dir), tip, _time("2024-01-12T12:00")).select("snapshot_id")


@query(f"WITH {SNAPSHOTS} SELECT n AS seq, snapshot_id, parent_id AS previous, 'new_commit' AS update_type FROM snapshots")
def ops_log(spark, sf_dir):
    s = derive.snapshots(spark, sf_dir)
    return s.select(F.row_number().over(Window.orderBy("snapshot_id")).cast("bigint").alias("seq"), "snapshot_id", F.col("parent_id").alias("previous"), F.lit("new_commit").alias("update_type")).orderBy(F.desc("seq"))


def _tx(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    change = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    return e.select(F.date_format("ts", "yyyyMMdd").alias("snapshot_id"), F.concat(F.lit("n"), F.pmod("user_id", F.lit(25)).cast("string")).alias("node_id"), change.alias("change"), F.array(F.pmod("event_id", F.lit(50)).cast("bigint")).alias("coord"))


_TX = "tx AS (SELECT strftime(ts, '%Y%m%d') AS snapshot_id, 'n' || cast(user_id % 25 AS varchar) AS node_id, CASE event_type WHEN 'signup' THEN 'new' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS change, cast(event_id % 50 AS varchar) AS coord FROM events)"


def _range(spark, sf_dir):
    s = derive.snapshots(spark, sf_dir)
    tip = derive.refs(spark, sf_dir).where("name = 'v2'")
    return history.ancestry(s, tip).where("depth < 3")


@query(f"WITH {REFS}, {NODES}, {_TX} SELECT DISTINCT change, path FROM tx JOIN nodes ON nodes.node_id = tx.node_id WHERE tx.snapshot_id IN (SELECT snapshot_id FROM snapshots WHERE n BETWEEN 8 AND 10)")
def diff_nodes(spark, sf_dir):
    return history.diff_nodes(_tx(spark, sf_dir), _range(spark, sf_dir), derive.nodes(spark, sf_dir).select("node_id", "path"))


@query(f"WITH {REFS}, {NODES}, {_TX} SELECT DISTINCT path, coord FROM tx JOIN nodes ON nodes.node_id = tx.node_id WHERE tx.snapshot_id IN (SELECT snapshot_id FROM snapshots WHERE n BETWEEN 8 AND 10)")
def diff_chunks(spark, sf_dir):
    return _text(history.diff_chunks(_tx(spark, sf_dir), _range(spark, sf_dir), derive.nodes(spark, sf_dir).select("node_id", "path")))


@query(f"WITH {NODES}, {_TX} SELECT path, count(DISTINCT coord) AS n FROM tx JOIN nodes ON nodes.node_id = tx.node_id WHERE snapshot_id = '20240105' GROUP BY path")
def status(spark, sf_dir):
    tx = _tx(spark, sf_dir).where("snapshot_id = '20240105'")
    return history.diff_chunks(tx, tx.select("snapshot_id").distinct(), derive.nodes(spark, sf_dir).select("node_id", "path")).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {_TX} SELECT DISTINCT change, node_id, coord FROM tx WHERE snapshot_id IN ('20240103', '20240104')")
def amend_merge_log(spark, sf_dir):
    tx = _text(_tx(spark, sf_dir))
    one, two = (tx.where(F.col("snapshot_id") == d).drop("snapshot_id") for d in ("20240103", "20240104"))
    return history.merged_log(one, two).select("change", "node_id", "coord")


_MOVES = "moves AS (SELECT cast(user_id AS varchar) AS node_id, event_id AS ordinal, '/p' || cast(event_id % 3 AS varchar) AS from_path, '/p' || cast(event_id % 5 AS varchar) AS to_path FROM events)"


@query(f"WITH {_MOVES}, f AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ordinal) AS a, row_number() OVER (PARTITION BY node_id ORDER BY ordinal DESC) AS z FROM moves) SELECT x.node_id, x.from_path, y.to_path FROM f x JOIN f y ON x.node_id = y.node_id WHERE x.a = 1 AND y.z = 1 AND x.from_path <> y.to_path")
def collapse_moves(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    place = lambda n: F.concat(F.lit("/p"), F.pmod("event_id", F.lit(n)).cast("string"))
    moves = e.select(F.col("user_id").cast("string").alias("node_id"), F.col("event_id").alias("ordinal"), place(3).alias("from_path"), place(5).alias("to_path"))
    return history.collapse_moves(moves)


@query(f"WITH {NODES} SELECT node_id, CASE WHEN path = '/ASIA' OR path LIKE '/ASIA/%' THEN '/EUROPE/old' || substr(path, 6) ELSE path END AS path FROM nodes")
def move_subtree(spark, sf_dir):
    return derive.nodes(spark, sf_dir).select("node_id", paths.rebased(F.col("path"), "/ASIA", "/EUROPE/old").alias("path"))


# conflicts


@query(f"WITH {SIDES} SELECT node_id, count(*) AS n FROM (SELECT DISTINCT node_id, coord FROM ours INTERSECT SELECT DISTINCT node_id, coord FROM theirs) t GROUP BY node_id")
def conflict_chunk_double_update(spark, sf_dir):
    return conflicts.chunk_double_updates(*derive.sides(spark, sf_dir))


@query(f"WITH {NODES} SELECT path || '/sub' AS path FROM nodes WHERE node_type = 'array'")
def conflict_new_in_array(spark, sf_dir):
    n = derive.nodes(spark, sf_dir)
    return conflicts.new_in_array(n.select(F.concat("path", F.lit("/sub")).alias("path")), n)


@query(f"WITH {SIDES}, {NODES}, gone AS (SELECT * FROM nodes WHERE node_id IN ('n1', 'n2', 'n3')) SELECT path FROM gone WHERE node_id IN (SELECT node_id FROM theirs)")
def conflict_delete_updated(spark, sf_dir):
    _, theirs = derive.sides(spark, sf_dir)
    n = derive.nodes(spark, sf_dir)
    none = n.where("false").withColumn("change", F.lit(""))
    gone = n.where("node_id in ('n1', 'n2', 'n3')").withColumn("change", F.lit("deleted"))
    found = conflicts.detect(gone, theirs.where("false"), none, theirs, none, n)
    return found.where("kind = 'delete_of_updated_array'").select("path")


_BOTH = f"""{NODES}, {SIDES}, k AS (SELECT *, cast(substr(node_id, 2) AS bigint) AS x FROM nodes),
a AS (SELECT CASE x % 5 WHEN 0 THEN 'updated' WHEN 1 THEN 'deleted' END AS change, node_id, path, node_type FROM k WHERE x % 5 < 2),
b AS (SELECT CASE x % 3 WHEN 0 THEN 'updated' WHEN 1 THEN 'deleted' END AS change, node_id, path, node_type FROM k WHERE x % 3 < 2),
fresh AS (SELECT path || '/sub' AS path, 'new' || node_id AS node_id FROM nodes UNION ALL SELECT path, 'again' || node_id FROM nodes),
tree AS (SELECT * FROM nodes WHERE node_id NOT IN (SELECT node_id FROM b WHERE change = 'deleted'))"""


@query(f"""WITH {_BOTH}, wrote AS (SELECT DISTINCT node_id FROM theirs), touched AS (SELECT DISTINCT node_id FROM ours)
SELECT 'move_cannot_be_rebased' AS kind, NULL AS path, NULL AS node_id, 1::BIGINT AS n
UNION ALL SELECT 'new_node_conflicts_with_existing', f.path, f.node_id, 1 FROM fresh f WHERE path IN (SELECT path FROM tree) AND path NOT IN (SELECT path FROM a WHERE change = 'deleted')
UNION ALL SELECT 'new_node_in_invalid_group', f.path, f.node_id, 1 FROM fresh f WHERE EXISTS (SELECT 1 FROM tree t WHERE t.node_type = 'array' AND f.path LIKE t.path || '/%')
UNION ALL SELECT 'metadata_double_update', a.path, a.node_id, 1 FROM a JOIN b USING (node_id) WHERE a.change = 'updated' AND b.change = 'updated'
UNION ALL SELECT 'metadata_update_of_deleted_' || a.node_type, a.path, a.node_id, 1 FROM a JOIN b USING (node_id) WHERE a.change = 'updated' AND b.change = 'deleted'
UNION ALL SELECT 'chunks_updated_in_deleted_array', b.path, b.node_id, 1 FROM b JOIN touched USING (node_id) WHERE change = 'deleted' AND node_type = 'array'
UNION ALL SELECT 'chunks_updated_in_updated_array', b.path, b.node_id, 1 FROM b JOIN touched USING (node_id) WHERE change = 'updated' AND node_type = 'array'
UNION ALL SELECT 'chunk_double_update', t.path, t.node_id, count(*) FROM tree t JOIN (SELECT DISTINCT node_id, coord FROM ours INTERSECT SELECT DISTINCT node_id, coord FROM theirs) d USING (node_id) GROUP BY t.path, t.node_id
UNION ALL SELECT 'delete_of_updated_array', a.path, a.node_id, 1 FROM a WHERE change = 'deleted' AND node_type = 'array' AND (node_id IN (SELECT node_id FROM b WHERE change = 'updated') OR node_id IN (SELECT node_id FROM wrote))
UNION ALL SELECT 'delete_of_updated_group', a.path, a.node_id, 1 FROM a WHERE change = 'deleted' AND node_type = 'group' AND node_id IN (SELECT node_id FROM b WHERE change = 'updated')""")
def conflict_kinds(spark, sf_dir):
    """All eleven kinds between two sessions that update, delete, write and move."""
    ours, theirs = derive.sides(spark, sf_dir)
    n = derive.nodes(spark, sf_dir)
    x = F.substring("node_id", 2, 20).cast("bigint")
    change = lambda m: F.when(F.pmod(x, F.lit(m)) == 0, "updated").when(F.pmod(x, F.lit(m)) == 1, "deleted")
    a, b = (n.withColumn("change", change(m)).where("change is not null") for m in (5, 3))
    fresh = n.select(F.concat(F.lit("new"), "node_id").alias("node_id"), F.concat("path", F.lit("/sub")).alias("path"), "node_type").unionByName(n.select(F.concat(F.lit("again"), "node_id").alias("node_id"), "path", "node_type"))
    tree = n.join(b.where("change = 'deleted'").select("node_id"), "node_id", "left_anti")
    return conflicts.detect(a.unionByName(fresh.withColumn("change", F.lit("new"))), ours, b, theirs, n, tree)


@query(f"WITH {SIDES} SELECT DISTINCT node_id, cast(coord AS varchar) AS coord FROM (SELECT node_id, coord FROM ours INTERSECT SELECT node_id, coord FROM theirs) t")
def conflict_chunk_coordinates(spark, sf_dir):
    return _text(conflicts.double_updated_chunks(*derive.sides(spark, sf_dir)))


@query(f"WITH {SIDES} SELECT o_orderkey, node_id FROM ours WHERE coord NOT IN (SELECT coord FROM theirs)")
def solve_use_theirs(spark, sf_dir):
    ours, theirs = derive.sides(spark, sf_dir)
    return conflicts.use_theirs(ours, theirs).select("o_orderkey", "node_id")


@query(f"WITH {SIDES}, u AS (SELECT coord, 0 AS ordinal, max(o_orderkey) AS payload FROM ours GROUP BY coord UNION ALL SELECT coord, 1, min(o_orderkey) FROM theirs GROUP BY coord), w AS (SELECT *, row_number() OVER (PARTITION BY coord ORDER BY ordinal DESC) AS r FROM u) SELECT cast(coord AS varchar) AS coord, payload FROM w WHERE r = 1")
def merge_lww(spark, sf_dir):
    ours, theirs = derive.sides(spark, sf_dir)
    one = ours.groupBy("coord").agg(F.max("o_orderkey").alias("payload"))
    two = theirs.groupBy("coord").agg(F.min("o_orderkey").alias("payload"))
    return _text(overlay.merge_sessions([one, two], ("coord",))).select("coord", "payload")


# arrays and grids

_ONE = f"{CHUNKS}, one AS (SELECT a, b, sum(length) AS length FROM chunks GROUP BY a, b)"


def _one(spark, sf_dir):
    return derive.chunk_refs(spark, sf_dir).groupBy("coord").agg(F.sum("length").alias("length"))


@query(f"WITH {_ONE}, moved AS (SELECT a + 1 AS a, b, length FROM one WHERE a < 10) SELECT cast(a AS varchar) || '/' || cast(b AS varchar) AS coord, cast(length AS bigint) AS length FROM (SELECT * FROM moved UNION ALL SELECT o.* FROM one o LEFT JOIN moved m ON m.a = o.a AND m.b = o.b WHERE m.a IS NULL) t")
def reindex_forward(spark, sf_dir):
    c = _one(spark, sf_dir)
    most = c.agg(F.max(F.element_at("coord", 1))).first()[0] + 2
    up = lambda x: F.when(F.element_at(x, 1) < 10, F.array(F.element_at(x, 1) + 1, F.element_at(x, 2)))
    return _text(arrays.reindex(c, up, [most, 9])).select("coord", "length")


@query(f"WITH {_ONE} SELECT cast(a - 2 AS varchar) || '/' || cast(b + 1 AS varchar) AS coord, cast(length AS bigint) AS length FROM one WHERE a - 2 >= 0 AND a < 12 AND b + 1 < 8")
def shift_array(spark, sf_dir):
    return _text(arrays.shift(_one(spark, sf_dir), [-2, 1], [12, 8])).select("coord", "length")


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0 ELSE cast((p_size + p_size % 7 - 1) // (p_size % 7) AS bigint) END AS n0, cast((p_partkey + 9) // 10 AS bigint) AS n1 FROM part")
def num_chunks_regular(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    n = grids.num_chunks(F.array(big("p_size"), big("p_partkey")), F.array(F.pmod("p_size", F.lit(7)).cast("bigint"), F.lit(10).cast("bigint")))
    return p.select("p_partkey", n.alias("n")).select("p_partkey", F.col("n")[0].alias("n0"), F.col("n")[1].alias("n1"))


@query("SELECT p_partkey, cast(p_size % 5 + p_size % 3 + 1 AS bigint) AS n FROM part")
def num_chunks_rectilinear(spark, sf_dir):
    run = lambda size, count: F.struct(F.lit(size).cast("bigint").alias("size"), count.cast("bigint").alias("count"))
    sizes = F.array(run(4, F.pmod("p_size", F.lit(5))), run(9, F.pmod("p_size", F.lit(3))), run(2, F.lit(1)))
    return read(spark, sf_dir, "part").select("p_partkey", grids.num_chunks_rectilinear(sizes).alias("n"))


@query("SELECT p_partkey, cast(greatest(0, least(8, p_size - 8 * (p_partkey % 6))) AS bigint) AS n FROM part")
def edge_chunk_shape(spark, sf_dir):
    one = lambda c: F.array(c.cast("bigint"))
    shape = grids.chunk_shape(one(F.col("p_size")), one(F.lit(8)), one(F.pmod("p_partkey", F.lit(6))))
    return read(spark, sf_dir, "part").select("p_partkey", shape[0].alias("n"))


@query(f"WITH {_ONE} SELECT cast(a AS varchar) || '/' || cast(b AS varchar) AS coord, a <= 9 AND b <= 4 AS valid FROM one")
def valid_coords(spark, sf_dir):
    grid = F.array(F.lit(10).cast("bigint"), F.lit(5).cast("bigint"))
    return _text(_one(spark, sf_dir).withColumn("valid", grids.valid_coord(F.col("coord"), grid))).select("coord", "valid")


@query(f"WITH {CHUNKS} SELECT node, cast(a // 4 AS varchar) || '/' || cast(b // 3 AS varchar) AS bucket, count(*) AS n FROM chunks GROUP BY 1, 2")
def split_buckets(spark, sf_dir):
    c = derive.chunk_refs(spark, sf_dir).withColumn("bucket", coord_text(grids.split_bucket(F.col("coord"), [4, 3])))
    return c.groupBy("node", "bucket").agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT node, cast(min(a) AS varchar) || '/' || cast(min(b) AS varchar) AS lo, cast(max(a) + 1 AS varchar) || '/' || cast(max(b) + 1 AS varchar) AS hi, count(*) AS n FROM chunks GROUP BY node")
def extents(spark, sf_dir):
    return arrays.extents(derive.chunk_refs(spark, sf_dir), ("node",), 2).select("node", coord_text(F.col("lo")).alias("lo"), coord_text(F.col("hi")).alias("hi"), "n")


@query(f"WITH {CHUNKS}, e AS (SELECT node, a // 4 AS k, min(a) AS l0, min(b) AS l1, max(a) + 1 AS h0, max(b) + 1 AS h1 FROM chunks GROUP BY 1, 2) SELECT node, k, CASE WHEN 3 <= l0 AND 1 <= l1 AND h0 <= 9 AND h1 <= 8 THEN 'complete' WHEN 3 < h0 AND 9 > l0 AND 1 < h1 AND 8 > l1 THEN 'partial' ELSE 'none' END AS overlap FROM e")
def box_overlap(spark, sf_dir):
    c = derive.chunk_refs(spark, sf_dir).withColumn("k", F.floor(F.element_at("coord", 1) / 4).cast("bigint"))
    e = arrays.extents(c, ("node", "k"), 2)
    box = [F.array(*[F.lit(x).cast("bigint") for x in v]) for v in ((3, 1), (9, 8))]
    return e.select("node", "k", grids.overlap(*box, F.col("lo"), F.col("hi")).alias("overlap"))


@query(f"WITH {CHUNKS} SELECT node, a // 8 AS split, count(*) AS refs, cast(sum(length) AS bigint) AS bytes, cast(min(a) AS bigint) AS lo, cast(max(a) + 1 AS bigint) AS hi FROM chunks GROUP BY 1, 2")
def rewrite_manifests_plan(spark, sf_dir):
    c = derive.chunk_refs(spark, sf_dir)
    first = F.element_at("coord", 1)
    return c.groupBy("node", F.floor(first / 8).cast("bigint").alias("split")).agg(F.count("*").alias("refs"), F.sum("length").alias("bytes"), F.min(first).alias("lo"), (F.max(first) + 1).alias("hi"))


_CELLS = "cells AS (SELECT vec_id AS i, cast(j AS bigint) AS j, vec_id // 50 AS ci, cast(j // 16 AS bigint) AS cj, embedding[cast(j + 1 AS integer)] AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS j FROM embeddings) t)"


@query(f"WITH {_CELLS} SELECT ci, cj, count(*) AS n FROM cells GROUP BY 1, 2")
def dense_chunk_counts(spark, sf_dir):
    e = arrays.cells(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", (50, 16))
    return e.groupBy("ci", "cj").agg(F.count("*").alias("n"))


@query("SELECT vec_id AS i, cast(j AS bigint) AS j, embedding[cast(j + 1 AS integer)] AS value FROM embeddings, (SELECT unnest(range(3, 7)) AS j) t WHERE vec_id >= 10 AND vec_id < 30")
def dense_slice(spark, sf_dir):
    e = arrays.cells(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", (50, 16))
    return arrays.dense_slice(e.select("i", "j", "value"), [(10, 30), (3, 7)], float("nan"))


@query(f"WITH {_CELLS} SELECT ci, cj, max(value) AS top, min(value) AS low FROM cells GROUP BY 1, 2")
def chunk_extremes(spark, sf_dir):
    e = arrays.cells(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", (50, 16))
    return e.groupBy("ci", "cj").agg(F.max("value").alias("top"), F.min("value").alias("low"))


@query(f"WITH {_CELLS}, n AS (SELECT max(i) + 1 AS n FROM cells) SELECT i, j, value FROM cells UNION ALL SELECT i + n, j, value FROM cells, n")
def dense_append_region(spark, sf_dir):
    e = arrays.cells(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", (50, 16)).select("i", "j", "value")
    size = read(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0] or 0
    return arrays.append(e, e, "i", size)


# virtual chunks


@query("SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN 'mobile' WHEN url LIKE 'https://%' THEN 'secure' WHEN url LIKE 'http://%' THEN 'plain' END AS container FROM pages")
def virtual_container_match(spark, sf_dir):
    containers = spark.createDataFrame([("plain", "http://"), ("secure", "https://"), ("mobile", "https://m.")], "name string, url_prefix string")
    return overlay.longest_prefix(read(spark, sf_dir, "pages").select("page_id", "url"), "url", containers).select("page_id", "container")


@query("SELECT doc_id, CASE source WHEN 'src1' THEN 's3://one/' || cast(doc_id AS varchar) WHEN 'src2' THEN 's3://two/x/' || cast(doc_id AS varchar) END AS location FROM documents")
def vcc_expand(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    at = F.concat(F.lit("vcc://"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", overlay.expand_alias(at, {"src1": "s3://one/", "src2": "s3://two/x/"}).alias("location"))


@query("WITH n AS (SELECT cast(max(doc_id) // 35 + 1 AS bigint) AS n FROM documents) SELECT doc_id, cast(doc_id // 35 % n AS varchar) || '/' || cast(doc_id // 5 % 7 AS varchar) || '/' || cast(doc_id % 5 AS varchar) AS coord, n_chars AS length FROM documents, n WHERE source <> 'src0'")
def unravel_virtual_refs(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    outer = (d.agg(F.max("doc_id")).first()[0] or 0) // 35 + 1
    # src0 stands for references without a location, which are skipped
    d = d.withColumn("location", F.when(F.col("source") == "src0", "").otherwise(F.col("source")))
    return arrays.flat_refs(d.select("doc_id", "location", F.col("n_chars").alias("length")), "doc_id", [outer, 7, 5]).select("doc_id", coord_text(F.col("coord")).alias("coord"), "length")


@query("SELECT r_regionkey, substr(r_name, 2, 3) AS bounded, substr(r_name, 3) AS from_, substr(r_name, 1, length(r_name) - 2) AS until_, substr(r_name, length(r_name) - 2) AS last_ FROM region")
def byte_range_slice(spark, sf_dir):
    cut = lambda kind, a, b=0: grids.byte_range(F.col("r_name").cast("binary"), F.lit(kind), F.lit(a), F.lit(b)).cast("string")
    return read(spark, sf_dir, "region").select("r_regionkey", cut("bounded", 1, 4).alias("bounded"), cut("from", 2).alias("from_"), cut("until", 2).alias("until_"), cut("last", 3).alias("last_"))


# maintenance


@query(f"WITH {REFS} SELECT snapshot_id FROM snapshots WHERE n <= 20 OR n <= (SELECT max(n) FROM snapshots)")
def reachable_snapshots(spark, sf_dir):
    return maintenance.reachable(derive.snapshots(spark, sf_dir), derive.refs(spark, sf_dir))


def _objects(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("chunk", "manifest", "snapshot"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return d.select(kind.alias("kind"), F.col("doc_id").alias("id"), F.pmod(F.col("doc_id") * 37, F.lit(100)).alias("created_at"), F.col("n_chars").alias("size_bytes"))


_OBJECTS = "objects AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'chunk' WHEN 1 THEN 'manifest' ELSE 'snapshot' END AS kind, doc_id AS id, doc_id * 37 % 100 AS created_at, n_chars AS size_bytes FROM documents), gone AS (SELECT * FROM objects WHERE created_at < 60 AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))"


def _gone(spark, sf_dir):
    o = _objects(spark, sf_dir)
    held = o.join(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), "id", "left_semi").select("kind", "id")
    return maintenance.orphans(o, held, 60)


@query(f"WITH {_OBJECTS} SELECT kind, id, size_bytes FROM gone")
def gc_orphans(spark, sf_dir):
    return _gone(spark, sf_dir).select("kind", "id", "size_bytes")


@query(f"WITH {_OBJECTS} SELECT kind, count(*) AS n, cast(sum(size_bytes) AS bigint) AS bytes FROM gone GROUP BY kind")
def gc_summary(spark, sf_dir):
    return maintenance.gc_summary(_gone(spark, sf_dir))


_EXPIRED = f"{REFS}, released AS (SELECT * FROM snapshots WHERE flushed_at < TIMESTAMP '2024-01-15 00:00:00' AND parent_id IS NOT NULL AND snapshot_id NOT IN (SELECT snapshot_id FROM refs))"


@query(f"WITH {_EXPIRED} SELECT snapshot_id FROM released")
def expire_released(spark, sf_dir):
    return maintenance.expire(derive.snapshots(spark, sf_dir), derive.refs(spark, sf_dir), _time("2024-01-15"))[0].select("snapshot_id")


@query(f"WITH {_EXPIRED} SELECT snapshot_id, CASE WHEN parent_id IN (SELECT snapshot_id FROM released) THEN (SELECT min(snapshot_id) FROM snapshots) ELSE parent_id END AS new_parent FROM snapshots WHERE snapshot_id NOT IN (SELECT snapshot_id FROM released)")
def expire_reparent(spark, sf_dir):
    return maintenance.expire(derive.snapshots(spark, sf_dir), derive.refs(spark, sf_dir), _time("2024-01-15"))[1]


@query("WITH refs AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS kind, l_partkey AS chunk_id, l_suppkey AS location, l_linenumber AS o, cast(l_quantity AS bigint) AS length FROM lineitem), n AS (SELECT 'native' AS kind, max(length) AS length FROM refs WHERE kind = 1 GROUP BY chunk_id), v AS (SELECT DISTINCT location, o, length FROM refs WHERE kind = 2), u AS (SELECT kind, length FROM n UNION ALL SELECT 'virtual', length FROM v UNION ALL SELECT 'inline', length FROM refs WHERE kind = 3) SELECT kind, cast(sum(length) AS bigint) AS bytes FROM u GROUP BY kind")
def storage_stats(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return maintenance.storage_stats(li.select(kind.alias("kind"), F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("location"), F.col("l_linenumber").alias("offset"), big("l_quantity").alias("length")))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 = 0 ELSE true END AS enabled FROM nation")
def feature_flags_effective(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    own = n.where("n_nationkey % 3 = 0").select("n_name", (F.col("n_nationkey") % 2 == 0).alias("own"))
    return n.select("n_name").join(own, "n_name", "left").select(F.col("n_name").alias("name"), F.coalesce("own", F.lit(True)).alias("enabled"))
