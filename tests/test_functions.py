"""Integer grids beyond doubles, keys, and chains by doubling."""

import pytest
from pyspark.sql import functions as F

from tesselwork.functions import grids, ids, paths, urls
from tesselwork.operators import history


def test_grids_are_exact_beyond_doubles(spark):
    n = 2**60 + 1
    row = spark.range(1).select(
        grids.num_chunks(F.array(F.lit(n)), F.array(F.lit(2).cast("bigint")))[0].alias("n"),
        grids.split_bucket(F.array(F.lit(n)), [3]).alias("b"),
        grids.unravel(F.lit(n), [2**61, 1]).alias("u"),
    ).first()
    assert (row.n, row.b[0], row.u[0]) == (2**59 + 1, n // 3, n)


def test_paths(spark):
    df = spark.createDataFrame([("/",), ("/a",), ("/a/b.c/d",)], "p string")
    got = df.select("p", paths.parent(F.col("p")).alias("up"), paths.name(F.col("p")).alias("n"), paths.depth(F.col("p")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("/", None, "", 0), ("/a", "/", "a", 1), ("/a/b.c/d", "/a/b.c", "d", 3)]


def test_ids_come_back():
    for size in (8, 12):
        raw = bytes(range(200, 200 + size))
        assert ids.decode(ids.encode(raw), size) == raw and len(ids.decode(ids.new_id(size).lower(), size)) == size


def test_chains_by_doubling(spark, monkeypatch):
    rows = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(37)] + [("alone", None), ("t", "s5")]
    df = spark.createDataFrame(rows, "snapshot_id string, parent_id string")
    starts = spark.createDataFrame([("s36",), ("t",), ("alone",)], "snapshot_id string")
    walked = sorted(tuple(r) for r in history.ancestry(df, starts).collect())
    assert len(walked) == 37 + 7 + 1
    monkeypatch.setattr(history, "DRIVER_SNAPSHOTS", 3)
    assert sorted(tuple(r) for r in history.ancestry(df, starts).collect()) == walked


def test_places(spark):
    cases = {
        "S3://Bucket/a//b/../c": "s3://Bucket/a//b/../c",
        "file:///x/./y/../z": "file:///x/z",
        "file:///x/%2E%2e/%2e/../y": "file:///y",
        "vcc://name/a": "vcc://name/a",
        "s3:///a": None,
        "s3:/a": None,
        "plain": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.location(F.col("u")).alias("l"), urls.object_key(F.col("u")).alias("k"), urls.bucket(F.col("u")).alias("b"))
    assert {r.u: r.l for r in rows.collect()} == cases
    one = spark.createDataFrame([("https://h:81/a%3Fb+c%25?q#f", '"e1"')], "u string, e string").select(urls.object_key(F.col("u")), urls.bucket(F.col("u")), urls.bare_etag(F.col("e"))).first()
    assert tuple(one) == ("a?b+c%", "https://h:81", "e1")


def test_conditions(spark):
    rows = spark.createDataFrame([("/a/temp",), ("/temp/b",), ("/",)], "p string")
    held = lambda c: [r.h for r in rows.select(paths.holds(F.col("p"), c).alias("h")).collect()]
    assert held({"path": "temp"}) == [True, True, False] and held({"name": "temp"}) == [True, False, False]
    assert held({"and": [{"path": "temp"}, {"name": "^b$"}]}) == [False, True, False] and held({"or": [{"name": "^b$"}, {"path": "^/$"}]}) == [False, True, True]
    assert held(None) == held({"and": []}) == [True] * 3 and held({"or": []}) == [False] * 3
    with pytest.raises(ValueError):
        held({"maybe": 1})
