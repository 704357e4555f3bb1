"""A repository of versioned arrays: immutable Parquet tables and a commit log.

A commit writes what changed - node rows, chunk rows (a manifest) and a transaction log - and
becomes visible by one log record.  A snapshot's chunks are the latest rows over its chain of
manifests, so a commit costs what it changes; rewrite_manifests folds the chain into one."""

from __future__ import annotations

import json
import re
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids, paths, urls
from ..functions.ids import new_id
from ..operators import arrays, conflicts, maintenance, overlay
from . import payloads
from .commit_log import CommitLog

NODES = "node_id string, path string, node_type string, user_data string, shape array<bigint>, chunk_shape array<bigint>, deleted boolean"
CHUNKS = "node_id string, coord array<bigint>, kind int, inline binary, chunk_id string, location string, offset bigint, length bigint, modified bigint, deleted boolean"
#: A chunk's first indices again, as columns of their own: Parquet keeps extents of those only.
AXES = ("c0", "c1", "c2")
EXTENTS = ", ".join(f"{a} bigint" for a in AXES)
MANIFEST = [c.split()[0] for c in CHUNKS.split(", ")]
#: Chunks longer than this are objects of their own; the others stand in the manifest.
INLINE_BYTES = 512
FLAGS = ("move_node", "create_tag", "delete_tag")


class RepositoryError(Exception):
    """Something the repository does not allow."""


class Conflict(RepositoryError):
    """The branch has moved on."""


class RebaseFailed(Conflict):
    """Conflicts that the solver leaves; they are in `conflicts`."""

    def __init__(self, found: list):
        super().__init__(f"{len(found)} conflicts")
        self.conflicts = found


def _now() -> float:
    return datetime.now(timezone.utc).timestamp()


class Repository:
    """Facade over one folder.  The driver holds the log record alone: references, snapshot
    infos, status, flags and metadata; nodes and chunks are DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Repository:
        self = cls(spark, path)
        if self.log.head() >= 0:
            raise RepositoryError("a repository is there already")
        root = new_id()
        info = {"parent": None, "at": _now(), "message": "Repository initialized", "metadata": {}, "manifests": [], "nodes": [], "on": {}, "tx": None}
        self.log.create(0, {"branches": {"main": root}, "tags": {}, "deleted_tags": [], "snapshots": {root: info}, "status": "online", "flags": {}, "metadata": {}, "config": {}, "ops": [{"at": _now(), "type": "repo_initialized"}]})
        with_root = self.spark.createDataFrame([(new_id(8), "/", "group", "{}", None, None, False)], NODES)
        table = f"nodes/{new_id()}"
        with_root.write.parquet(f"{self.path}/{table}")
        self._change(lambda r: r["snapshots"][root]["nodes"].append(table), "root_written")
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Repository:
        self = cls(spark, path)
        if self.log.head() < 0:
            raise RepositoryError("no repository there")
        return self

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str) -> Repository:
        return cls.open(spark, path) if cls.exists(spark, path) else cls.create(spark, path)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return CommitLog(spark, path).head() >= 0

    @property
    def record(self) -> dict:
        return self.log.read(self.log.head())

    def _change(self, change, kind: str, **detail) -> dict:
        def apply(record: dict) -> dict:
            if record["status"] != "online" and kind != "status_set":
                raise RepositoryError(f"the repository is {record['status']}")
            change(record)
            at = max(_now(), record["ops"][-1]["at"] + 1e-6)
            record["ops"].append({"at": at, "type": kind} | detail)
            return record

        return self.log.update(apply)

    # references

    def create_branch(self, name: str, snapshot_id: str) -> None:
        def change(r: dict) -> None:
            if name in r["branches"]:
                raise RepositoryError("the branch exists")
            r["branches"][name] = self._known(r, snapshot_id)

        self._change(change, "branch_created", branch=name)

    def delete_branch(self, name: str) -> None:
        if name == "main":
            raise RepositoryError("main cannot be deleted")
        self._change(lambda r: r["branches"].pop(self._member(r["branches"], name)), "branch_deleted", branch=name)

    def reset_branch(self, name: str, snapshot_id: str, expected: str | None = None) -> None:
        def change(r: dict) -> None:
            tip = r["branches"][self._member(r["branches"], name)]
            if expected is not None and tip != expected:
                raise Conflict("the branch is elsewhere")
            r["branches"][name] = self._known(r, snapshot_id)

        self._change(change, "branch_reset", branch=name, snapshot=snapshot_id)

    def create_tag(self, name: str, snapshot_id: str) -> None:
        def change(r: dict) -> None:
            self._allowed(r, "create_tag")
            if name in r["tags"] or name in r["deleted_tags"]:
                raise RepositoryError("the tag exists or has existed")
            r["tags"][name] = self._known(r, snapshot_id)

        self._change(change, "tag_created", tag=name)

    def delete_tag(self, name: str) -> None:
        def change(r: dict) -> None:
            self._allowed(r, "delete_tag")
            r["tags"].pop(self._member(r["tags"], name))
            r["deleted_tags"].append(name)

        self._change(change, "tag_deleted", tag=name)

    def list_branches(self) -> list[str]:
        return sorted(self.record["branches"])

    def list_tags(self) -> list[str]:
        return sorted(self.record["tags"])

    @staticmethod
    def _member(names: dict, name: str) -> str:
        if name not in names:
            raise RepositoryError(f"no {name}")
        return name

    @staticmethod
    def _known(record: dict, snapshot_id: str) -> str:
        return Repository._member(record["snapshots"], snapshot_id)

    @staticmethod
    def _allowed(record: dict, flag: str) -> None:
        if not record["flags"].get(flag, True):
            raise RepositoryError(f"{flag} is switched off")

    def resolve(self, branch: str | None = None, tag: str | None = None, snapshot_id: str | None = None, as_of: datetime | None = None) -> str:
        """The snapshot of a branch, tag or id; with as_of the branch's first ancestor written at
        or before that time."""
        r = self.record
        if snapshot_id:
            return self._known(r, snapshot_id)
        if tag:
            return r["tags"][self._member(r["tags"], tag)]
        tip = r["branches"][self._member(r["branches"], branch or "main")]
        if as_of is None:
            return tip
        for s in self._chain(r, tip):
            if r["snapshots"][s]["at"] <= as_of.timestamp():
                return s
        raise RepositoryError("no snapshot that old")

    @staticmethod
    def _chain(record: dict, start: str) -> list[str]:
        out = []
        while start is not None:
            out.append(start)
            start = record["snapshots"][start]["parent"]
        return out

    # what the log says, as DataFrames

    def ancestry(self, **version) -> list[dict]:
        r = self.record
        return [{"id": s} | {k: r["snapshots"][s][k] for k in ("parent", "at", "message", "metadata")} for s in self._chain(r, self.resolve(**version))]

    def ops_log(self) -> list[dict]:
        return self.record["ops"][::-1]

    def snapshots(self) -> DataFrame:
        rows = [(k, v["parent"], datetime.fromtimestamp(v["at"], timezone.utc), v["message"]) for k, v in self.record["snapshots"].items()]
        return self.spark.createDataFrame(rows, "snapshot_id string, parent_id string, flushed_at timestamp, message string")

    def refs(self) -> DataFrame:
        r = self.record
        rows = [("branch", k, v) for k, v in r["branches"].items()] + [("tag", k, v) for k, v in r["tags"].items()]
        return self.spark.createDataFrame(rows, "kind string, name string, snapshot_id string")

    def set_status(self, status: str) -> None:
        if status not in ("online", "read_only", "offline"):
            raise RepositoryError("unknown status")
        self._change(lambda r: r.update(status=status), "status_set", status=status)

    def set_flag(self, flag: str, value: bool | None) -> None:
        if flag not in FLAGS:
            raise RepositoryError("unknown flag")
        self._change(lambda r: r["flags"].pop(flag, None) if value is None else r["flags"].update({flag: value}), "flag_set", flag=flag)

    def flags(self) -> dict[str, bool]:
        return {f: self.record["flags"].get(f, True) for f in FLAGS}

    def update_metadata(self, values: dict) -> None:
        self._change(lambda r: r["metadata"].update(values), "metadata_updated")

    def set_metadata(self, values: dict) -> None:
        self._change(lambda r: r.update(metadata=dict(values)), "metadata_set")

    @property
    def metadata(self) -> dict:
        return self.record["metadata"]

    def set_container(self, name: str, url_prefix: str) -> None:
        """A place that virtual chunks may point to; its prefix ends with a slash."""
        if not re.fullmatch(r"[a-z][a-z0-9+.-]*://[^?#]*/", url_prefix):
            raise RepositoryError("a container's prefix is scheme://.../")
        self._change(lambda r: r["config"].setdefault("containers", {}).update({name: url_prefix}), "container_set", container=name)

    def containers(self) -> dict[str, str]:
        return dict(self.record["config"].get("containers", {}))

    def clear_containers(self) -> None:
        self._change(lambda r: r["config"].pop("containers", None), "containers_cleared")

    def set_default_commit_metadata(self, values: dict) -> None:
        """Metadata that every later commit has unless it says otherwise."""
        self._change(lambda r: r.update(config=r["config"] | {"commit_metadata": dict(values)}), "config_saved")

    @property
    def config(self) -> dict:
        return self.record["config"]

    def save_config(self, config: dict) -> None:
        self._change(lambda r: r.update(config=r["config"] | config), "config_saved")

    # tables of a snapshot

    @staticmethod
    def _listed(record: dict, snapshot_id: str | None, kind: str) -> list[str]:
        """A snapshot's tables of a kind, oldest first: its info names its own ones and the
        snapshot they lie on."""
        out = []
        while snapshot_id is not None:
            info = record["snapshots"][snapshot_id]
            out.append(info[kind])
            snapshot_id = info.get("on", {}).get(kind)
        return [t for own in reversed(out) for t in own]

    @staticmethod
    def _based(record: dict, infos: dict[str, dict]) -> dict[str, dict]:
        """infos, each with the tables of those it lies on that are no longer among them."""
        out = {}
        for s, v in infos.items():
            on, lists = dict(v.get("on", {})), {}
            for kind in ("manifests", "nodes"):
                own, at = [v[kind]], on.get(kind)
                while at is not None and at not in infos:
                    own.append(record["snapshots"][at][kind])
                    at = record["snapshots"][at].get("on", {}).get(kind)
                on[kind], lists[kind] = at, [t for one in reversed(own) for t in one]
            out[s] = v | lists | {"on": on}
        return out

    def tables(self, snapshot_id: str, kind: str) -> list[str]:
        return self._listed(self.record, snapshot_id, kind)

    def _layers(self, tables: list[str], schema: str) -> DataFrame:
        """The rows of several tables with layer, a table's place in the list: one scan, however
        many commits there are."""
        if not tables:
            return self.spark.createDataFrame([], schema).withColumn("layer", F.lit(0))
        found = self.spark.read.schema(schema).parquet(*[f"{self.path}/{t}" for t in tables])
        if len(tables) == 1:
            return found.withColumn("layer", F.lit(0))
        names = self.spark.createDataFrame([(t.rsplit("/", 1)[-1], i) for i, t in enumerate(tables)], "_table string, layer int")
        named = found.withColumn("_of", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return named.join(F.broadcast(names) if len(tables) <= 100_000 else names, F.col("_of") == F.col("_table")).drop("_of", "_table")

    def nodes(self, snapshot_id: str) -> DataFrame:
        layers = self._layers(self.tables(snapshot_id, "nodes"), NODES)
        return overlay.latest(layers, ("node_id",), "layer").where("not deleted").drop("layer", "deleted")

    def chunks(self, snapshot_id: str, node_id: str | None = None, box: list[tuple[int, int]] | None = None) -> DataFrame:
        """Live chunks, or those of one array, or those of its grid positions in a half-open box.
        Array and box reach the scan of the manifests, whose files are skipped by their extents."""
        rows = self._layers(self.tables(snapshot_id, "manifests"), f"{CHUNKS}, {EXTENTS}")
        if node_id is not None:
            rows = rows.where(F.col("node_id") == node_id)
        rows = arrays.in_box(rows, box, AXES).drop(*AXES)
        live = overlay.latest(rows, ("node_id", "coord"), "layer").where("not deleted").drop("layer", "deleted")
        return live.join(self.nodes(snapshot_id).select("node_id"), "node_id", "left_semi")

    def set_split_rules(self, rules: list[dict]) -> None:
        """How manifests are split from the next commit or rewrite on: ordered rules with when (a
        condition on the array's path, see paths.holds), axis (a number) and size (chunks along
        the axis); a rule without when or axis holds for all, and the first that matches an
        axis decides.  Axes without a rule are not split."""
        for r in rules:
            if r.get("size", 0) < 1 or r.keys() - {"when", "axis", "size"}:
                raise RepositoryError("a rule has a size of 1 or more, and perhaps when and axis")
        # a faulty expression raises here and not in the next commit
        found = {p for r in rules for p in paths.patterns(r.get("when"))}
        self.spark.range(1).select(F.lit(0), *[F.lit("/").rlike(p) for p in sorted(found)]).collect()
        self._change(lambda r: r["config"].update(splits=[dict(x) for x in rules]), "config_saved")

    def _arranged(self, rows: DataFrame, nodes: DataFrame, ranged: bool) -> DataFrame:
        """Manifest rows in the files they are written to: with rules, ranges of splits, so that a
        file holds few of them and its extents are small; else ranges of coordinates, or as they are."""
        rules = self.config.get("splits")
        if not rules:
            return (rows.repartitionByRange("node_id", "coord") if ranged else rows).sortWithinPartitions("node_id", "coord")
        sizes = nodes.where("node_type = 'array'").select("node_id", arrays.split_sizes(F.col("path"), F.size("shape"), rules).alias("_sizes"))
        split = grids.split_of(F.col("coord"), F.col("_sizes"))
        cut = rows.join(sizes, "node_id", "left").withColumn("_split", split)
        order = ("node_id", "_split", "coord")
        return cut.repartitionByRange(*order).sortWithinPartitions(*order).drop("_sizes", "_split")

    def _write_manifest(self, rows: DataFrame, nodes: DataFrame, table: str, ranged: bool = False) -> None:
        axes = [F.get("coord", F.lit(i)).alias(a) for i, a in enumerate(AXES)]
        self._arranged(rows, nodes, ranged).select(*rows.columns, *axes).write.parquet(f"{self.path}/{table}")

    def _tx(self, snapshot_ids: list[str], part: str, schema: str) -> DataFrame:
        snapshots = self.record["snapshots"]
        places = [f"{self.path}/{t}/{part}" for s in snapshot_ids for t in snapshots[s]["tx"] or ()]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def diff(self, from_id: str, to_id: str) -> tuple[DataFrame, DataFrame]:
        """((change, path), (path, coord)) of the commits after from_id up to to_id; from_id must
        be a proper ancestor."""
        chain = self._chain(self.record, to_id)
        if from_id == to_id or from_id not in chain:
            raise RepositoryError("not a proper ancestor")
        ids = chain[: chain.index(from_id)]
        ends = self.nodes(from_id).select("node_id", "path").withColumn("o", F.lit(0)).unionByName(self.nodes(to_id).select("node_id", "path").withColumn("o", F.lit(1)))
        named = ends.groupBy("node_id").agg(F.max_by("path", "o").alias("path"))
        changed = self._tx(ids, "nodes", "change string, node_id string").distinct().join(named, "node_id").select("change", "path")
        chunks = self._tx(ids, "chunks", "node_id string, coord array<bigint>").distinct().join(named, "node_id").select("path", "coord")
        return changed, chunks

    def session(self, branch: str | None = None, read_only: bool = False, **version) -> Session:
        if not read_only and self.record["status"] != "online":
            raise RepositoryError("the repository takes no writes")
        return Session(self, self.resolve(branch, **version), None if read_only else branch or "main")

    @contextmanager
    def transaction(self, branch: str = "main", message: str = "", solver: str | None = None):
        s = self.session(branch)
        yield s
        s.commit(message, solver=solver)

    # maintenance

    def storage_stats(self) -> dict[str, int]:
        """Bytes of native, virtual and inline chunks over all snapshots: native chunks by id,
        virtual ones by place, inline ones each time a manifest holds them."""
        tables = sorted({t for s in self.record["snapshots"].values() for t in s["manifests"]})
        refs = self._layers(tables, CHUNKS).where("not deleted")
        return {"native": 0, "virtual": 0, "inline": 0} | {r["kind"]: r["bytes"] for r in maintenance.storage_stats(refs).collect()}

    def expire_snapshots(self, older_than: datetime, delete_expired_branches: bool = False, delete_expired_tags: bool = False) -> set[str]:
        """Drop snapshots written before a time; tips stay unless told otherwise, main's always,
        and what remains is put below the root if its parent went."""
        released: set[str] = set()

        def change(r: dict) -> None:
            released.clear()
            cut = older_than.timestamp()
            old = {s for s, v in r["snapshots"].items() if v["at"] < cut and v["parent"] is not None}
            if delete_expired_branches:
                r["branches"] = {k: v for k, v in r["branches"].items() if k == "main" or v not in old}
            if delete_expired_tags:
                gone = {k for k, v in r["tags"].items() if v in old}
                r["deleted_tags"] += sorted(gone)
                r["tags"] = {k: v for k, v in r["tags"].items() if k not in gone}
            released.update(old - set(r["branches"].values()) - set(r["tags"].values()))
            # a survivor put below the root takes over the logs of what stood between
            kept = {}
            for s, v in r["snapshots"].items():
                if s not in released:
                    chain = self._chain(r, s)
                    kept[s] = self._inherited(r, v, chain[1:-1], chain[-1]) if v["parent"] in released else v
            r["snapshots"] = self._based(r, kept)

        self._change(change, "expiration_ran")
        return released

    @staticmethod
    def _inherited(record: dict, info: dict, between: list[str], parent: str) -> dict:
        """The info of a snapshot below another parent, with the logs of those between them."""
        logs = [t for s in [*reversed(between)] for t in record["snapshots"][s]["tx"] or ()]
        return info | {"parent": parent, "tx": [*logs, *(info["tx"] or ())]}

    def _collected(self, record: dict, created_before: float) -> dict:
        """The snapshots that garbage collection leaves: those a branch or tag reaches and those
        not older than the time, the latter below their nearest ancestor that stays."""
        infos, reached = record["snapshots"], set()
        for s in [*record["branches"].values(), *record["tags"].values()]:
            while s is not None and s not in reached:
                reached.add(s)
                s = infos[s]["parent"]
        stay = {s for s, v in infos.items() if s in reached or v["at"] >= created_before}
        out = {}
        for s, info in infos.items():
            if s in stay:
                between, above = [], info["parent"]
                while above is not None and above not in stay:
                    between.append(above)
                    above = infos[above]["parent"]
                out[s] = self._inherited(record, info, between, above) if between and above is not None else info
        return self._based(record, out)

    def garbage_collect(self, created_before: datetime, dry_run: bool = False) -> dict[str, int]:
        """Delete tables that no snapshot reaches from a branch or tag, if they are older than a
        time.  The log goes first: a table is deleted only once no record names it."""
        r, cut = self.record, created_before.timestamp()
        if not dry_run and len(self._collected(r, cut)) < len(r["snapshots"]):
            # what is kept is worked out on the record that is changed: a branch may be new
            r = self._change(lambda r: r.update(snapshots=self._collected(r, cut)), "gc_ran")
        held = {t for v in self._collected(r, cut).values() for t in [*v["manifests"], *v["nodes"], *(v["tx"] or ())]}
        # payload tables live while a manifest in use names them
        manifests = sorted(t for t in held if t.startswith("manifests/"))
        held |= {row[0] for row in self._layers(manifests, CHUNKS).where("kind = 1 and location is not null").select("location").distinct().collect()}
        out = {"tables": 0, "bytes": 0}
        fs, at = self.log._fs, self.log._jvm.org.apache.hadoop.fs.Path
        for kind in ("nodes", "manifests", "transactions", "chunks"):
            where = at(f"{self.path}/{kind}")
            for s in fs.listStatus(where) if fs.exists(where) else ():
                if f"{kind}/{s.getPath().getName()}" not in held and s.getModificationTime() / 1000 < created_before.timestamp():
                    out["tables"] += 1
                    out["bytes"] += fs.getContentSummary(s.getPath()).getLength()
                    if not dry_run:
                        fs.delete(s.getPath(), True)
        return out


class Session:
    """Uncommitted changes on a snapshot: small driver rows for nodes, DataFrames for chunks."""

    def __init__(self, repo: Repository, base: str, branch: str | None):
        self.repo, self.base, self.branch, self.spark = repo, base, branch, repo.spark
        self._nodes: dict[str, tuple] = {}  # node_id -> row of NODES
        self._change: dict[str, str] = {}  # node_id -> new, updated or deleted
        self._chunks: list[DataFrame] = []
        self._moves: list[tuple[str, str]] = []
        self._native = False  # whether chunks were written that may become objects

    @property
    def read_only(self) -> bool:
        return self.branch is None

    @property
    def has_uncommitted_changes(self) -> bool:
        return bool(self._change or self._chunks or self._moves)

    def _writable(self) -> None:
        if self.read_only:
            raise RepositoryError("the session is read only")

    def nodes(self) -> DataFrame:
        """The tree with this session's changes."""
        base = self.repo.nodes(self.base).withColumn("deleted", F.lit(False))
        mine = self.spark.createDataFrame(list(self._nodes.values()), NODES)
        return overlay.live(base.drop("deleted"), mine, ("node_id",)).select(*[c for c in base.columns if c != "deleted"])

    def chunks(self, node_id: str | None = None, box: list[tuple[int, int]] | None = None) -> DataFrame:
        """Live chunks with this session's changes, or those of one array, or of a box of it."""
        base = self.repo.chunks(self.base, node_id, box)
        if self._chunks:
            mine = self._delta() if node_id is None else self._delta().where(F.col("node_id") == node_id)
            base = overlay.live(base, arrays.in_box(mine, box), ("node_id", "coord"))
        return base.join(self.nodes().select("node_id"), "node_id", "left_semi")

    def _delta(self) -> DataFrame:
        return overlay.merge_sessions(self._chunks, ("node_id", "coord")).drop("ordinal")

    def node(self, path: str):
        return self.nodes().where(F.col("path") == path).first()

    def list_nodes(self, prefix: str = "/", when: dict | None = None) -> DataFrame:
        return self.nodes().where(paths.under(F.col("path"), prefix) & paths.holds(F.col("path"), when))

    def _array(self, path: str):
        found = self.node(path)
        if found is None or found.node_type != "array":
            raise RepositoryError(f"no array at {path}")
        return found

    def _put(self, row: tuple, change: str) -> None:
        before = self._change.get(row[0])
        self._nodes[row[0]] = row
        self._change[row[0]] = "new" if before == "new" and change == "updated" else change

    def add_group(self, path: str, user_data: dict | None = None) -> None:
        self._add(path, "group", user_data, None, None)

    def add_array(self, path: str, shape: list[int], chunk_shape: list[int], user_data: dict | None = None) -> None:
        self._add(path, "array", user_data, list(shape), list(chunk_shape))

    def _add(self, path, kind, user_data, shape, chunk_shape) -> None:
        self._writable()
        if not paths.valid_path(path):
            raise RepositoryError("paths are absolute and canonical")
        if self.node(path) is not None:
            raise RepositoryError(f"{path} exists")
        self._put((new_id(8), path, kind, json.dumps(user_data or {}), shape, chunk_shape, False), "new")

    def update_node(self, path: str, user_data: dict | None = None, shape: list[int] | None = None) -> None:
        """Replace metadata or shape; identical values are no change."""
        self._writable()
        n = self.node(path)
        if n is None:
            raise RepositoryError(f"nothing at {path}")
        data = n.user_data if user_data is None else json.dumps(user_data)
        now = (n.node_id, n.path, n.node_type, data, n["shape"] if shape is None else list(shape), n.chunk_shape, False)
        if (data, now[4]) != (n.user_data, n["shape"]):
            self._put(now, "updated")

    def delete_node(self, path: str) -> None:
        """Delete a node and all below it; a missing one is no error."""
        self._writable()
        for n in self.list_nodes(path).collect():
            if self._change.get(n.node_id) == "new":
                del self._nodes[n.node_id], self._change[n.node_id]
            else:
                self._put((n.node_id, n.path, n.node_type, n.user_data, n["shape"], n.chunk_shape, True), "deleted")

    def move_node(self, source: str, target: str) -> None:
        """Move a node with all below it; ids stay."""
        self._writable()
        self.repo._allowed(self.repo.record, "move_node")
        if self._chunks or any(c != "moved" for c in self._change.values()):
            raise RepositoryError("moves and edits do not mix")
        above = self.node(target.rsplit("/", 1)[0] or "/")
        if source == "/" or target == source or target.startswith(source + "/") or self.node(source) is None or self.node(target) is not None or above is None or above.node_type != "group":
            raise RepositoryError("this move is not possible")
        for n in self.list_nodes(source).collect():
            self._put((n.node_id, target + n.path[len(source) :], n.node_type, n.user_data, n["shape"], n.chunk_shape, False), "moved")
        self._moves.append((source, target))

    def set_chunks(self, path: str, chunks: DataFrame) -> None:
        """Write many chunks: (coord array<bigint>, data binary).  Short ones are kept in the
        manifest, others become rows of a payload table when they are committed; coordinates
        outside the grid raise."""
        inline = F.length("data") <= INLINE_BYTES
        rows = chunks.select("coord", F.when(inline, 3).otherwise(1).alias("kind"), F.col("data").alias("inline"), F.when(~inline, F.sha1("data")).alias("chunk_id"), F.lit(None).cast("string").alias("location"), F.lit(0).cast("bigint").alias("offset"), F.length("data").cast("bigint").alias("length"), F.lit(False).alias("deleted"))
        self._write(path, rows)
        self._native = True

    def set_virtual_refs(self, path: str, refs: DataFrame, prefixes: tuple[str, ...] | None = None) -> DataFrame:
        """Point chunks at byte ranges elsewhere: (coord, location, offset, length, and perhaps
        modified, seconds: reads of an object written after that raise).  With prefixes only
        locations below one of them are taken; the rows refused are returned, as are those that
        are no places."""
        refs = refs.withColumn("_given", F.col("location")).withColumn("location", urls.location(F.col("location")))
        good = F.col("location").isNotNull()
        if prefixes is not None:
            below = F.lit(False)
            for p in prefixes:
                below = below | F.startswith("location", F.lit(p))
            good = good & below & ~F.col("location").rlike(r"(?<!:)//|/\.{1,2}(/|$)")
        rows = refs.where(good).select("coord", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("inline"), F.lit(None).cast("string").alias("chunk_id"), "location", F.col("offset").cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"), (F.col("modified") if "modified" in refs.columns else F.lit(None)).cast("bigint").alias("modified"), F.lit(False).alias("deleted"))
        self._write(path, rows)
        return refs.where(~F.coalesce(good, F.lit(False))).withColumn("location", F.col("_given")).drop("_given")

    def set_checked_refs(self, path: str, refs: DataFrame) -> DataFrame:
        """set_virtual_refs with the repository's containers as the only places allowed;
        vcc://name/... stands for a place in the container of that name."""
        known = self.repo.containers()
        expanded = refs.withColumn("location", F.coalesce(overlay.expand_alias(F.col("location"), known), "location")) if known else refs
        return self.set_virtual_refs(path, expanded, tuple(known.values()))

    def set_flat_refs(self, path: str, refs: DataFrame, grid: list[int]) -> None:
        """References (position, location, offset, length) to an array's chunks in C order; those
        without a location are skipped."""
        found = arrays.flat_refs(refs, "position", grid).select("coord", "location", "offset", "length")
        self.set_virtual_refs(path, found)

    def virtual_locations(self) -> DataFrame:
        """The places that the chunks of all arrays point to, once each."""
        return self.chunks().where("kind = 2").select("location").distinct()

    def delete_chunks(self, path: str, coords: DataFrame) -> None:
        none = F.lit(None)
        self._write(path, coords.select("coord", F.lit(0).alias("kind"), none.cast("binary").alias("inline"), none.cast("string").alias("chunk_id"), none.cast("string").alias("location"), none.cast("bigint").alias("offset"), none.cast("bigint").alias("length"), F.lit(True).alias("deleted")), check=False)

    def _write(self, path: str, rows: DataFrame, check: bool = True) -> None:
        self._writable()
        if self._moves:
            raise RepositoryError("moves and edits do not mix")
        n = self._array(path)
        if check:
            grid = F.array(*[F.lit(-(-s // c) if c else 0).cast("bigint") for s, c in zip(n["shape"], n.chunk_shape)])
            if not rows.where(~grids.valid_coord(F.col("coord"), grid) | (F.col("length") <= 0)).isEmpty():
                raise RepositoryError("a chunk lies outside the grid or is empty")
        if "modified" not in rows.columns:
            rows = rows.withColumn("modified", F.lit(None).cast("bigint"))
        self._chunks.append(rows.select(F.lit(n.node_id).alias("node_id"), *rows.columns))

    def array_chunks(self, path: str, box: list[tuple[int, int]] | None = None) -> DataFrame:
        return self.chunks(self._array(path).node_id, box).drop("node_id")

    def read_chunks(self, path: str, coords: list[list[int]] | None = None, unchanged_since: datetime | None = None) -> DataFrame:
        """(coord, data) of an array's chunks, or of a few of them: inline, native or virtual.
        Objects of virtual chunks written after unchanged_since raise."""
        box = [(min(x), max(x) + 1) for x in zip(*coords)] if coords else None
        rows = self.array_chunks(path, box)
        if coords is not None:
            rows = rows.where(F.col("coord").isin(*[F.array(*[F.lit(c).cast("bigint") for c in at]) for at in coords]))
        return payloads.with_data(rows, self.repo.path, unchanged_since)

    def _grid(self, n) -> list[int]:
        return [-(-s // c) if c else 0 for s, c in zip(n["shape"], n.chunk_shape)]

    def shift_array(self, path: str, offset: list[int]) -> None:
        n = self._array(path)
        before = self.array_chunks(path).withColumn("deleted", F.lit(False))
        after = arrays.shift(before, offset, self._grid(n))
        self._replace(path, before, after)

    def reindex_array(self, path: str, forward, clear: bool = False) -> None:
        n = self._array(path)
        before = self.array_chunks(path).withColumn("deleted", F.lit(False))
        self._replace(path, before, arrays.reindex(before, forward, self._grid(n), clear))

    def _replace(self, path: str, before: DataFrame, after: DataFrame) -> None:
        gone = before.select("coord").join(after.select("coord"), "coord", "left_anti")
        self.delete_chunks(path, gone)
        self._write(path, after)

    def keys(self, prefix: str = "") -> DataFrame:
        """Store keys below a prefix, on component boundaries."""
        n = self.nodes()
        c = self.chunks().join(n.select("node_id", "path"), "node_id")
        whole = n.select(paths.metadata_key(F.col("path")).alias("key")).union(c.select(paths.chunk_key(F.col("path"), F.col("coord"))))
        return whole.where(paths.under(F.col("key"), prefix.strip("/"))) if prefix.strip("/") else whole

    def status(self) -> tuple[DataFrame, DataFrame]:
        """((change, path), (path, coord)) of what is not committed."""
        named = self.nodes().select("node_id", "path").union(self.repo.nodes(self.base).select("node_id", "path")).dropDuplicates(["node_id"])
        changed = self.spark.createDataFrame([(c, self._nodes[k][1]) for k, c in self._change.items()], "change string, path string")
        if not self._chunks:
            return changed, self.spark.createDataFrame([], "path string, coord array<bigint>")
        return changed, self._delta().join(named, "node_id").select("path", "coord")

    def discard_changes(self) -> None:
        self._nodes, self._change, self._chunks, self._moves, self._native = {}, {}, [], [], False

    def fork(self) -> Session:
        """A session on the same snapshot with this one's changes so far, for another writer;
        merge brings its changes back."""
        out = Session(self.repo, self.base, self.branch)
        out._nodes, out._change, out._chunks, out._moves, out._native = dict(self._nodes), dict(self._change), list(self._chunks), list(self._moves), self._native
        return out

    def as_bytes(self) -> bytes:
        """The session for another process: chunk changes are written below the repository."""
        table = None
        if self._chunks:
            table = f"forks/{new_id()}"
            self._delta().write.parquet(f"{self.repo.path}/{table}")
        return json.dumps({"path": self.repo.path, "base": self.base, "branch": self.branch, "nodes": self._nodes, "change": self._change, "moves": self._moves, "native": self._native, "chunks": table}).encode()

    @staticmethod
    def from_bytes(spark: SparkSession, data: bytes) -> Session:
        x = json.loads(data)
        out = Session(Repository.open(spark, x["path"]), x["base"], x["branch"])
        out._nodes, out._change, out._moves, out._native = {k: tuple(v) for k, v in x["nodes"].items()}, x["change"], [tuple(m) for m in x["moves"]], x["native"]
        if x["chunks"]:
            out._chunks = [spark.read.parquet(f"{x['path']}/{x['chunks']}")]
        return out

    def _wrote_under(self, deleted: list[str]) -> bool:
        return bool(deleted and self._chunks) and not self._delta().where(F.col("node_id").isin(deleted) & ~F.col("deleted")).isEmpty()

    def merge(self, *others: Session) -> None:
        """Take over the changes of sessions on the same snapshot; later ones win a chunk.
        Different metadata for one node is refused, and chunks written below a node that the
        other session deleted."""
        for o in others:
            if o.base != self.base:
                raise RepositoryError("the sessions start from different snapshots")
            gone, theirs_gone = ([k for k, c in x._change.items() if c == "deleted"] for x in (self, o))
            if o._wrote_under([k for k in gone if k not in theirs_gone]) or self._wrote_under([k for k in theirs_gone if k not in gone]):
                raise RepositoryError("one session deleted what the other wrote to")
            for k, row in o._nodes.items():
                if k in self._nodes and self._nodes[k] != row:
                    raise RepositoryError("both sessions changed a node")
                self._nodes[k], self._change[k] = row, o._change[k]
            self._chunks += [c for c in o._chunks if not any(c is x for x in self._chunks)]
            self._native |= o._native

    def conflicts_with(self, snapshot_id: str) -> DataFrame:
        """Conflicts of this session with one commit."""
        repo, info = self.repo, self.repo.record["snapshots"][snapshot_id]
        tree = repo.nodes(snapshot_id)
        before = repo.nodes(info["parent"])
        named = before.select("node_id", "path", "node_type").unionByName(tree.select("node_id", "path", "node_type")).dropDuplicates(["node_id"])
        theirs = repo._tx([snapshot_id], "nodes", "change string, node_id string").join(named, "node_id")
        mine = self.spark.createDataFrame([(c, k, self._nodes[k][1], self._nodes[k][2]) for k, c in self._change.items()], "change string, node_id string, path string, node_type string")
        none = self.spark.createDataFrame([], "node_id string, coord array<bigint>")
        chunks = self._delta().select("node_id", "coord") if self._chunks else none
        return conflicts.detect(mine, chunks, theirs, repo._tx([snapshot_id], "chunks", "node_id string, coord array<bigint>"), theirs.where("change = 'moved'"), tree)

    def conflicting_chunks(self, snapshot_id: str) -> DataFrame:
        """(path, coord) of the chunks that this session and one commit wrote both."""
        repo = self.repo
        if not self._chunks:
            return self.spark.createDataFrame([], "path string, coord array<bigint>")
        both = conflicts.double_updated_chunks(self._delta(), repo._tx([snapshot_id], "chunks", "node_id string, coord array<bigint>"))
        return both.join(repo.nodes(snapshot_id).select("node_id", "path"), "node_id").select("path", "coord")

    def rebase(self, solver: str | None = None, delete_of_updated: bool = True) -> None:
        """Put this session on top of its branch, checking each newer commit, oldest first.

        solver: None stops at any conflict; "ours" and "theirs" settle chunks both wrote, and
        both let a deletion of an updated node stand unless delete_of_updated is false."""
        repo = self.repo
        tip = repo.record["branches"][self.branch]
        chain = repo._chain(repo.record, tip)
        if self.base not in chain:
            raise RepositoryError("the branch no longer holds this session's snapshot")
        for s in chain[: chain.index(self.base)][::-1]:
            found = self.conflicts_with(s).collect()
            left = [c for c in found if not (solver and (c.kind == "chunk_double_update" or delete_of_updated and c.kind.startswith("delete_of_updated")))]
            if solver == "theirs" and any(c.kind == "chunk_double_update" for c in found):
                theirs = repo._tx([s], "chunks", "node_id string, coord array<bigint>")
                self._chunks = [conflicts.use_theirs(self._delta(), theirs).select(*self._chunks[0].columns)]
            # a chunk conflict brings its array's other checks with it; those stay unsolved
            if left:
                raise RebaseFailed(left)
            self.base = s

    def commit(self, message: str, metadata: dict | None = None, solver: str | None = None, rebase: bool | None = None, allow_empty: bool = False, amend: bool = False, anonymous: bool = False, tries: int = 5) -> str:
        """Write the changes as a new snapshot on the branch and return its id; the session then
        reads that snapshot only."""
        self._writable()
        if not self.has_uncommitted_changes and not (allow_empty or amend):
            raise RepositoryError("nothing to commit")
        repo = self.repo
        for attempt in range(tries + 1):
            snapshot_id, tables = new_id(), self._tables()
            base = self.base

            def change(r: dict) -> None:
                info = r["snapshots"][base]
                if not anonymous and r["branches"].get(self.branch) != base:
                    raise Conflict("the branch has moved")
                if amend and info["parent"] is None:
                    raise RepositoryError("the first snapshot cannot be amended")
                tx = [tables["tx"]] if tables["tx"] else []
                r["snapshots"][snapshot_id] = {
                    "parent": info["parent"] if amend else base,
                    "at": max(_now(), info["at"] + 1e-6),
                    "message": message,
                    "metadata": r["config"].get("commit_metadata", {}) | (metadata or {}),
                    "manifests": (info["manifests"] if amend else []) + ([tables["chunks"]] if tables["chunks"] else []),
                    "nodes": (info["nodes"] if amend else []) + ([tables["nodes"]] if tables["nodes"] else []),
                    "on": info.get("on", {}) if amend else {"manifests": base, "nodes": base},
                    "tx": ((info["tx"] or []) if amend else []) + tx,
                }
                if not anonymous:
                    r["branches"][self.branch] = snapshot_id

            try:
                repo._change(change, "commit_amended" if amend else "detached_snapshot" if anonymous else "new_commit", branch=self.branch, snapshot=snapshot_id)
            except Conflict:
                if attempt == tries or not (rebase or solver):
                    raise
                self.rebase(solver)
                continue
            self.discard_changes()
            self.base, self.branch = snapshot_id, None
            return snapshot_id
        raise Conflict("gave up")

    def amend(self, message: str, **more) -> str:
        return self.commit(message, amend=True, **more)

    def flush(self, message: str) -> str:
        return self.commit(message, anonymous=True)

    def rewrite_manifests(self, message: str) -> str:
        """Commit this snapshot's chunks as one manifest, in ranges of node, split and coordinate."""
        self._writable()
        repo, base, snapshot_id = self.repo, self.base, new_id()
        table = f"manifests/{new_id()}"
        live = repo.chunks(base).withColumn("deleted", F.lit(False)).select(*MANIFEST)
        repo._write_manifest(live, repo.nodes(base), table, ranged=True)

        def change(r: dict) -> None:
            if r["branches"].get(self.branch) != base:
                raise Conflict("the branch has moved")
            info = r["snapshots"][base]
            r["snapshots"][snapshot_id] = info | {"parent": base, "at": max(_now(), info["at"] + 1e-6), "message": message, "manifests": [table], "nodes": [], "on": {"nodes": base}, "tx": []}
            r["branches"][self.branch] = snapshot_id

        repo._change(change, "manifests_rewritten", snapshot=snapshot_id)
        self.base, self.branch = snapshot_id, None
        return snapshot_id

    def _tables(self) -> dict[str, str | None]:
        repo, out = self.repo, {"nodes": None, "chunks": None, "tx": None}
        if self._nodes:
            out["nodes"] = f"nodes/{new_id()}"
            self.spark.createDataFrame(list(self._nodes.values()), NODES).write.parquet(f"{repo.path}/{out['nodes']}")
        if self._chunks:
            out["chunks"] = f"manifests/{new_id()}"
            rows = self._delta().select(*MANIFEST)
            if self._native:
                new = F.coalesce((F.col("kind") == 1) & F.col("inline").isNotNull() & ~F.col("deleted"), F.lit(False))
                rows = rows.where(~new).unionByName(payloads.write_objects(rows.where(new), repo.path, f"chunks/{new_id()}"))
            repo._write_manifest(rows, self.nodes(), out["chunks"])
        if self._nodes or self._chunks:
            out["tx"] = f"transactions/{new_id()}"
            self.spark.createDataFrame([(c, k) for k, c in self._change.items()], "change string, node_id string").write.parquet(f"{repo.path}/{out['tx']}/nodes")
            wrote = self.spark.read.schema(CHUNKS).parquet(f"{repo.path}/{out['chunks']}") if out["chunks"] else self.spark.createDataFrame([], CHUNKS)
            wrote.select("node_id", "coord").write.parquet(f"{repo.path}/{out['tx']}/chunks")
        return out
