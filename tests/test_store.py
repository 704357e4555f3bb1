"""Chunk payloads of every kind, the key-value view, drawings and the command line."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tesselwork import cli
from tesselwork.sources import display
from tesselwork.sources.repository import Repository, RepositoryError
from tesselwork.sources.store import Store, cut, parsed


@pytest.fixture
def repo(spark, tmp_path):
    return Repository.create(spark, f"file://{tmp_path}/repo")


def test_payloads(spark, repo, tmp_path):
    place = tmp_path / "far.bin"
    place.write_bytes(bytes(range(100)))
    s = repo.session()
    s.add_array("/a", [9], [1])
    s.set_chunks("/a", spark.range(6).select(F.array("id").alias("coord"), F.expr("cast(repeat(cast(id as string), if(id < 3, 5, 600)) as binary)").alias("data")))
    s.set_virtual_refs("/a", spark.createDataFrame([([6], f"file://{place}", 10, 5), ([7], f"file://{place}", 0, 2)], "coord array<bigint>, location string, offset long, length long"))
    want = {i: str(i).encode() * (5 if i < 3 else 600) for i in range(6)} | {6: bytes(range(10, 15)), 7: b"\x00\x01"}
    read = lambda s: {r.coord[0]: bytes(r.data) for r in s.read_chunks("/a").collect()}
    assert read(s) == want
    s.commit("one")
    assert read(repo.session(read_only=True)) == want
    assert repo.session(read_only=True).array_chunks("/a").where("kind = 1 and inline is not null").isEmpty()
    assert repo.storage_stats() == {"native": 1800, "virtual": 7, "inline": 15}
    t = repo.session()
    t.shift_array("/a", [1])
    t.commit("moved")
    assert read(repo.session(read_only=True)) == {k + 1: v for k, v in want.items()}
    assert repo.storage_stats()["native"] == 1800
    later = datetime.now(timezone.utc) + timedelta(hours=1)
    assert repo.garbage_collect(later)["tables"] == 0 and read(repo.session(read_only=True))[4] == want[3]
    with pytest.raises(Exception, match="has changed"):
        repo.session(read_only=True).read_chunks("/a", unchanged_since=datetime(2000, 1, 1, tzinfo=timezone.utc)).collect()
    u = repo.session()
    u.set_virtual_refs("/a", spark.createDataFrame([([0], f"file://{place}", 99, 5)], "coord array<bigint>, location string, offset long, length long"))
    with pytest.raises(Exception, match="ends before"):
        u.read_chunks("/a", [[0]]).collect()


def test_keys():
    assert parsed("a/c/c/0/1") == ("/a/c", [0, 1]) and parsed("zarr.json") == ("/", None) and parsed("a/c") == ("/a", [])
    with pytest.raises(RepositoryError):
        parsed("a/b")
    data = b"0123456789"
    assert (cut(data, 2, 4), cut(data, 7), cut(data, last=3), cut(data, until=3), cut(data, last=20)) == (b"23", b"789", b"789", b"0123456", data)


def test_store(spark, repo):
    store = Store(repo.session())
    group, array = {"zarr_format": 3, "node_type": "group"}, {"zarr_format": 3, "node_type": "array", "shape": [4, 4], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2, 2]}}, "fill_value": 0}
    store.set("g/zarr.json", json.dumps(group).encode())
    store.set("g/a/zarr.json", json.dumps(array).encode())
    store.set("g/a/c/0/1", b"abcdef")
    store.set("g/a/c/1/1", b"z" * 600)
    store.set_if_not_exists("g/a/c/0/1", b"other")
    assert json.loads(store.get("g/a/zarr.json")) == array and store.get("g/a/c/0/1", start=1, end=3) == b"bc"
    assert store.get("g/a/c/0/0") is None and store.get("h/zarr.json") is None and not store.exists("g/a/c/0/0")
    store.session.commit("one")
    store = Store(repo.session())
    assert store.get_many([("g/a/c/1/1", {"last": 2}), ("g/a/c/0/1", {})]) == [b"zz", b"abcdef"]
    many = store.get_many([("g/a/c/0/1", {"start": 1, "end": 3}), ("nowhere/c/0", {}), ("g/zarr.json", {}), ("g/a/c/0/1", {"start": "x"}), ("g/a/c/1/1", {"last": 1})])
    assert many[0] == b"bc" and many[1] is None and many[2] == store.get("g/zarr.json") and isinstance(many[3], Exception) and many[4] == b"z"
    assert {tuple(r) for r in store.list_dir("g/a").collect()} == {("zarr.json", "key"), ("c", "prefix")}
    assert {tuple(r) for r in store.list_dir("").collect()} == {("zarr.json", "key"), ("g", "prefix")}
    assert store.getsize("g/a/c/1/1") == 600 and store.getsize_prefix("g/a") == 606 + len(json.dumps(array)) and not store.is_empty("g")
    store.delete_dir("g/a/c/1")
    assert not store.exists("g/a/c/1/1") and store.exists("g/a/c/0/1")
    store.delete("g/a/c/0/1")
    store.delete("g/a/c/0/1")
    assert {r.key for r in store.list("g").collect()} == {"g/zarr.json", "g/a/zarr.json"}
    store.clear()
    assert store.is_empty()


def test_drawings_and_command_line(spark, repo):
    root = repo.resolve()
    with repo.transaction(message="on main") as s:
        s.add_group("/g")
    repo.create_branch("dev", root)
    with repo.transaction("dev", message="on dev") as s:
        s.add_group("/h")
    rows = display.lanes(repo)
    assert [r[1] for r in rows] == [0, 1, 0] and [r[3] for r in rows] == [["dev"], ["main"], []]
    text = display.graph(repo).split("\n")
    assert text[0].startswith("* ") and text[1].startswith("| * ") and text[2].endswith("Repository initialized")
    assert display.svg(repo).count("<circle") == 3
    run = lambda *a: cli.main(list(a), spark)
    assert run("branch", "list", repo.path) == "dev\nmain"
    run("tag", "create", repo.path, "v1")
    assert run("tag", "list", repo.path) == "v1" and "on main" in run("ancestry", repo.path, "--tag", "v1")
    run("branch", "delete", repo.path, "dev")
    assert run("branch", "list", repo.path) == "main"
    assert [n["path"] for n in json.loads(run("inspect", repo.path))["tree"]] == ["/", "/g"]
    assert json.loads(display.inspect_transaction(repo, repo.resolve()))["nodes"][0]["change"] == "new"
    assert json.loads(display.inspect_repository(repo))["tags"].keys() == {"v1"}
