"""Worked examples of the repository facade."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tesselwork.functions import grids
from tesselwork.operators import arrays
from tesselwork.sources.repository import Conflict, RebaseFailed, Repository, RepositoryError


@pytest.fixture
def repo(spark, tmp_path):
    return Repository.create(spark, f"file://{tmp_path}/repo")


def chunks(spark, start, stop, size=6, rank=1):
    return spark.range(start, stop).select(F.array(*[F.col("id")] * rank).alias("coord"), F.rpad(F.col("id").cast("string"), size, "x").cast("binary").alias("data"))


def values(session, path):
    return {tuple(r.coord): bytes(r.inline).decode().rstrip("x") for r in session.array_chunks(path).collect()}


def test_commit_and_time_travel(spark, repo):
    s = repo.session()
    s.add_group("/g")
    s.add_array("/g/a", [10], [1])
    s.set_chunks("/g/a", chunks(spark, 0, 10))
    assert s.status()[1].count() == 10
    first = s.commit("one")
    with pytest.raises(RepositoryError):
        s.add_group("/h")
    with repo.transaction(message="two") as t:
        t.set_chunks("/g/a", spark.range(1).selectExpr("array(3L) coord", "cast('new' as binary) data"))
        t.delete_chunks("/g/a", spark.range(1).selectExpr("array(4L) coord"))
    now, then = repo.session(read_only=True), repo.session(read_only=True, snapshot_id=first)
    assert values(now, "/g/a") == {(i,): "new" if i == 3 else str(i) for i in range(10) if i != 4}
    assert values(then, "/g/a") == {(i,): str(i) for i in range(10)}
    assert [x["message"] for x in repo.ancestry()] == ["two", "one", "Repository initialized"]
    changed, wrote = repo.diff(first, repo.resolve())
    assert changed.count() == 0 and {tuple(r.coord) for r in wrote.collect()} == {(3,), (4,)}
    assert repo.resolve(as_of=datetime.fromtimestamp(repo.ancestry()[1]["at"], timezone.utc) + timedelta(microseconds=1)) == first
    with pytest.raises(RepositoryError):
        repo.session().commit("nothing")
    assert {r.key for r in now.keys("g/a").collect()} == {"g/a/zarr.json"} | {f"g/a/c/{i}" for i in range(10) if i != 4}


def test_storage_stats(spark, repo):
    s = repo.session()
    s.add_array("/array", [100], [1])
    assert repo.storage_stats() == {"native": 0, "virtual": 0, "inline": 0}
    big = lambda a, b: spark.range(a, b).select(F.array("id").alias("coord"), F.rpad(F.col("id").cast("string"), 600, "y").cast("binary").alias("data"))
    s.set_chunks("/array", big(0, 50))
    s.set_chunks("/array", chunks(spark, 50, 60, 1))
    s.set_virtual_refs("/array", spark.range(10).selectExpr("array(id + 60) coord", "'s3://b/file' location", "id * 100 offset", "100 length"))
    s.set_virtual_refs("/array", spark.range(5).selectExpr("array(id + 70) coord", "'s3://b/file' location", "0 offset", "100 length"))
    s.commit("one")
    assert repo.storage_stats() == {"native": 30000, "virtual": 1000, "inline": 10}


def test_virtual_prefixes(spark, repo):
    s = repo.session()
    s.add_array("/v", [10], [1])
    rows = spark.createDataFrame([([0], "s3://ok/a", 0, 5), ([1], "s3://no/a", 0, 5), ([2], "s3://ok/../a", 0, 5)], "coord array<bigint>, location string, offset int, length int")
    assert s.set_virtual_refs("/v", rows, ("s3://ok/",)).count() == 2
    assert s.array_chunks("/v").count() == 1


@pytest.mark.parametrize("offset,want", [(-4, {i - 4: i for i in range(4, 25)}), (4, {i + 4: i for i in range(21)})])
def test_shift(spark, repo, offset, want):
    s = repo.session()
    s.add_array("/a", [50], [2])
    s.set_chunks("/a", chunks(spark, 0, 25))
    s.shift_array("/a", [offset])
    s.commit("shifted")
    assert values(repo.session(read_only=True), "/a") == {(k,): str(v) for k, v in want.items()}


def test_reindex_leaves_or_clears(spark, repo):
    back = lambda c: F.when(F.element_at(c, 1) >= 4, F.array(F.element_at(c, 1) - 4))
    s = repo.session()
    s.add_array("/a", [50], [2])
    s.set_chunks("/a", chunks(spark, 0, 25))
    s.reindex_array("/a", back)
    assert values(s, "/a") == {(i,): str(i + 4 if i < 21 else i) for i in range(25)}


def test_conflicts_and_rebase(spark, repo):
    s = repo.session()
    s.add_array("/a", [10, 10], [1, 1])
    s.commit("made")
    one, two, three = repo.session(), repo.session(), repo.session()
    for x, name in ((one, "p"), (two, "q"), (three, "r")):
        x.set_chunks("/a", spark.range(5).select(F.array("id", "id").alias("coord"), F.lit(name).cast("binary").alias("data")))
    one.commit("first")
    with pytest.raises(Conflict):
        two.commit("second")
    with pytest.raises(RebaseFailed) as e:
        two.rebase()
    assert [(c.kind, c.n) for c in e.value.conflicts] == [("chunk_double_update", 5)]
    assert {(r.path, *r.coord) for r in two.conflicting_chunks(repo.resolve()).collect()} == {("/a", i, i) for i in range(5)}
    two.commit("second", solver="ours")
    assert set(values(repo.session(read_only=True), "/a").values()) == {"q"}
    three.set_chunks("/a", spark.range(1).selectExpr("array(9L, 9L) coord", "cast('r' as binary) data"))
    three.commit("third", solver="theirs")
    assert values(repo.session(read_only=True), "/a") == {(i, i): "q" for i in range(5)} | {(9, 9): "r"}
    old = repo.session()
    repo_b = repo.session()
    repo_b.update_node("/a", {"x": 1})
    repo_b.commit("meta")
    old.update_node("/a", {"x": 2})
    with pytest.raises(RebaseFailed) as e:
        old.commit("meta too", solver="ours")
    assert {c.kind for c in e.value.conflicts} == {"metadata_double_update"}


def test_references(spark, repo):
    s = repo.session()
    s.add_group("/g")
    first = s.commit("one")
    repo.create_branch("dev", first)
    repo.create_tag("v1", first)
    repo.delete_tag("v1")
    with pytest.raises(RepositoryError):
        repo.create_tag("v1", first)
    with pytest.raises(RepositoryError):
        repo.delete_branch("main")
    d = repo.session("dev")
    d.add_group("/d")
    tip = d.commit("dev")
    assert repo.resolve("dev") == tip and repo.resolve() == first
    repo.reset_branch("dev", first, tip)
    with pytest.raises(Conflict):
        repo.reset_branch("dev", tip, tip)
    repo.set_status("read_only")
    with pytest.raises(RepositoryError):
        repo.session()
    repo.set_status("online")
    repo.set_flag("create_tag", False)
    with pytest.raises(RepositoryError):
        repo.create_tag("v2", first)
    ops = repo.ops_log()
    assert [o["at"] for o in ops] == sorted((o["at"] for o in ops), reverse=True) and ops[0]["type"] == "flag_set"


def test_move(spark, repo):
    s = repo.session()
    for p in ("/my", "/my/old", "/my/old/path", "/my/new"):
        s.add_group(p)
    s.add_array("/my/old/path/array", [10], [10])
    s.commit("made")
    before = {r.path: r.node_id for r in repo.session().nodes().collect()}
    m = repo.session()
    with pytest.raises(RepositoryError):
        m.move_node("/my/old", "/my/old/path/x")
    m.move_node("/my/old/path", "/my/new/path")
    with pytest.raises(RepositoryError):
        m.set_chunks("/my/new/path/array", chunks(spark, 0, 1))
    m.commit("moved")
    after = {r.path: r.node_id for r in repo.session().nodes().collect()}
    assert after["/my/new/path/array"] == before["/my/old/path/array"] and "/my/old/path" not in after


def test_amend_expire_and_collect(spark, repo):
    s = repo.session()
    s.add_array("/array", [100], [10])
    s.commit("made")
    for i in range(4):
        t = repo.session()
        t.set_chunks("/array", chunks(spark, i, i + 1))
        t.commit(f"c{i}")
    cut = datetime.now(timezone.utc)
    t = repo.session()
    t.set_chunks("/array", chunks(spark, 7, 8))
    t.commit("newer")
    a = repo.session()
    a.set_chunks("/array", chunks(spark, 8, 9))
    tip = a.amend("newer, amended")
    assert [x["message"] for x in repo.ancestry()][:2] == ["newer, amended", "c3"]
    released = repo.expire_snapshots(cut)
    assert len(released) == 5
    assert [x["id"] for x in repo.ancestry()][0] == tip and len(repo.ancestry()) == 2
    later = datetime.now(timezone.utc) + timedelta(hours=1)
    dry = repo.garbage_collect(later, dry_run=True)
    assert dry["tables"] > 0 and repo.garbage_collect(later)["tables"] >= dry["tables"]
    assert sorted(values(repo.session(read_only=True), "/array")) == [(i,) for i in (0, 1, 2, 3, 7, 8)]
    w = repo.session()
    w.rewrite_manifests("folded")
    assert len(repo.record["snapshots"][repo.resolve()]["manifests"]) == 1
    assert sorted(values(repo.session(read_only=True), "/array")) == [(i,) for i in (0, 1, 2, 3, 7, 8)]


def test_history_survives_expiration(spark, repo):
    ids = []
    for name in "abcd":
        s = repo.session()
        s.add_array(f"/{name}", [10], [1])
        s.set_chunks(f"/{name}", chunks(spark, 0, 2))
        ids.append(s.commit(name))
    root = repo.ancestry()[-1]["id"]
    before = {tuple(r) for r in repo.diff(root, ids[-1])[0].collect()}, repo.diff(root, ids[-1])[1].count()
    assert len(before[0]) == 4 and before[1] == 8
    cut = datetime.fromtimestamp(repo.record["snapshots"][ids[2]]["at"], timezone.utc) + timedelta(microseconds=1)
    assert repo.expire_snapshots(cut) == set(ids[:3])
    assert [x["id"] for x in repo.ancestry()] == [ids[3], root]
    assert ({tuple(r) for r in repo.diff(root, ids[3])[0].collect()}, repo.diff(root, ids[3])[1].count()) == before
    repo.garbage_collect(datetime.now(timezone.utc) + timedelta(days=1))
    assert ({tuple(r) for r in repo.diff(root, ids[3])[0].collect()}, repo.diff(root, ids[3])[1].count()) == before
    assert values(repo.session(read_only=True), "/a") == {(0,): "0", (1,): "1"}


def test_collection_reparents_young_snapshots(spark, repo):
    old = repo.session()
    old.add_array("/x", [10], [1])
    first = old.commit("old")
    repo.create_branch("side", first)
    root = repo.ancestry()[-1]["id"]
    repo.reset_branch("main", root)
    s = repo.session("side")
    s.set_chunks("/x", chunks(spark, 0, 3))
    second = s.commit("young")
    repo.delete_branch("side")
    cut = datetime.fromtimestamp(repo.record["snapshots"][second]["at"], timezone.utc)
    repo.garbage_collect(cut)
    assert [x["id"] for x in repo.ancestry(snapshot_id=second)] == [second, root]
    changed, written = repo.diff(root, second)
    assert {tuple(r) for r in changed.collect()} >= {("new", "/x")} and written.count() == 3


def test_forks_travel_and_merge(spark, repo):
    s = repo.session()
    s.add_array("/a", [10], [1])
    s.add_array("/b", [10], [1])
    s.commit("arrays")
    s = repo.session()
    one, two = s.fork(), type(s).from_bytes(spark, s.fork().as_bytes())
    one.set_chunks("/a", chunks(spark, 0, 2))
    two.set_chunks("/a", chunks(spark, 2, 4))
    two = type(s).from_bytes(spark, two.as_bytes())
    s.merge(one, two)
    repo.set_default_commit_metadata({"by": "default", "run": "1"})
    s.commit("merged", metadata={"by": "me"})
    assert repo.ancestry()[0]["metadata"] == {"by": "me", "run": "1"} and repo.config["commit_metadata"]["by"] == "default"
    assert set(values(repo.session(read_only=True), "/a")) == {(0,), (1,), (2,), (3,)}
    s = repo.session()
    gone, wrote = s.fork(), s.fork()
    gone.delete_node("/b")
    wrote.set_chunks("/b", chunks(spark, 0, 1))
    for a, b in ((gone, wrote), (wrote, gone)):
        with pytest.raises(RepositoryError):
            a.merge(b)


def test_many_commits_are_one_scan(spark, repo):
    s = repo.session()
    s.add_array("/a", [10], [1])
    s.commit("array")
    for i in range(6):
        s = repo.session()
        s.set_chunks("/a", chunks(spark, i, i + 2))
        s.commit(str(i))
    session = repo.session(read_only=True)
    assert set(values(session, "/a")) == {(i,) for i in range(7)}
    plan = repo._layers(repo.tables(repo.resolve(), "manifests"), "node_id string")._jdf.queryExecution().executedPlan().toString()
    assert len(repo.tables(repo.resolve(), "manifests")) == 6 and plan.count("FileScan") == 1


def test_containers_and_flat_references(spark, repo):
    for bad in ("s3://x", "x/", "s3:/x/"):
        with pytest.raises(RepositoryError):
            repo.set_container("bad", bad)
    repo.set_container("one", "s3://one/data/")
    repo.set_container("two", "s3://two/")
    assert repo.containers() == {"one": "s3://one/data/", "two": "s3://two/"}
    s = repo.session()
    s.add_array("/v", [6, 4], [2, 2])
    rows = spark.createDataFrame([([0, 0], "vcc://one/a", 0, 5), ([0, 1], "s3://two/b", 0, 5), ([1, 0], "s3://other/c", 0, 5), ([1, 1], "s3://two/../c", 0, 5)], "coord array<bigint>, location string, offset bigint, length bigint")
    assert s.set_checked_refs("/v", rows).count() == 2
    s.set_flat_refs("/v", spark.createDataFrame([(4, "s3://two/e", 0, 1), (5, "", 0, 1)], "position bigint, location string, offset bigint, length bigint"), [3, 2])
    assert {r.location for r in s.virtual_locations().collect()} == {"s3://one/data/a", "s3://two/b", "s3://two/e"}
    assert {tuple(r.coord) for r in s.array_chunks("/v").collect()} == {(0, 0), (0, 1), (2, 0)}
    repo.clear_containers()
    assert repo.containers() == {}


def test_split_rules_and_pruned_reads(spark, repo):
    with pytest.raises(RepositoryError):
        repo.set_split_rules([{"size": 0}])
    with pytest.raises(Exception):
        repo.set_split_rules([{"when": {"path": "("}, "size": 1}])
    repo.set_split_rules([{"when": {"path": "^/a$"}, "axis": 0, "size": 4}, {"when": {"and": [{"name": "^a$"}, {"or": [{"path": "x"}, {"path": "a"}]}]}, "size": 100}, {"axis": 1, "size": 5}])
    s = repo.session()
    s.add_array("/a", [40, 40], [1, 1])
    s.add_array("/b", [40, 40], [1, 1])
    for p in ("/a", "/b"):
        s.set_chunks(p, spark.range(1600).selectExpr("array(id div 40, id % 40) coord", "cast(cast(id as string) as binary) data"))
    s.commit("one")
    t = repo.session()
    t.set_chunks("/a", spark.range(1).selectExpr("array(5L, 6L) coord", "cast('new' as binary) data"))
    t.delete_chunks("/a", spark.range(1).selectExpr("array(5L, 7L) coord"))
    box, want = [(4, 6), (5, 8)], {(i, j): str(40 * i + j) for i in (4, 5) for j in (5, 6, 7)} | {(5, 6): "new"}
    del want[5, 7]
    assert values_in(t, box) == want
    t.commit("two")
    r = repo.session(read_only=True)
    assert values_in(r, box) == want and r.array_chunks("/b").count() == 1600
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = r.array_chunks("/a", box)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c0,4)" in plan and "LessThan(c1,8)" in plan and "EqualTo(node_id" in plan
    assert [bytes(x.data) for x in r.read_chunks("/a", [[5, 6], [30, 2]]).orderBy("coord").collect()] == [b"new", b"1202"]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    w = repo.session()
    w.rewrite_manifests("folded")
    assert values_in(repo.session(read_only=True), box) == want and len(repo.tables(repo.resolve(), "manifests")) == 1


def values_in(session, box):
    return {tuple(r.coord): bytes(r.inline).decode() for r in session.array_chunks("/a", box).collect()}


def test_split_sizes(spark):
    rules = [{"when": {"path": "temp"}, "axis": 0, "size": 3}, {"axis": 2, "size": 7}, {"when": {"path": "temp"}, "size": 9}]
    rows = spark.createDataFrame([("/temp", 3), ("/other", 3), ("/temp", 0)], "path string, n int")
    got = rows.select(arrays.split_sizes(F.col("path"), F.col("n"), rules).alias("s"))
    assert [r.s for r in got.collect()] == [[3, 9, 7], [None, None, 7], []]
    assert spark.range(1).select(grids.split_of(F.expr("array(10L, 20L)"), F.expr("array(4L, null)")).alias("s")).first().s == [2, 0]


def test_references_to_objects_of_a_time(spark, repo, tmp_path):
    (tmp_path / "object").write_bytes(b"0123456789")
    os.utime(tmp_path / "object", (1000, 1000))
    s = repo.session()
    s.add_array("/v", [2], [1])
    s.set_virtual_refs("/v", spark.range(2).select(F.array("id").alias("coord"), F.lit(f"file://{tmp_path}/object").alias("location"), F.col("id").alias("offset"), F.lit(3).alias("length"), F.when(F.col("id") == 0, 1000).otherwise(999).alias("modified")))
    s.commit("one")
    r = repo.session(read_only=True)
    assert bytes(r.read_chunks("/v", [[0]]).first().data) == b"012"
    with pytest.raises(Exception, match="has changed"):
        r.read_chunks("/v", [[1]]).collect()
