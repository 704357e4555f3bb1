"""The key-value view of a session: metadata documents and chunks by store key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .repository import RepositoryError, Session

META = "zarr.json"


def parsed(key: str) -> tuple[str, list[int] | None]:
    """(node path, chunk coordinates or None for the metadata document) of a key, cut at its
    last `c`."""
    parts = key.strip("/").split("/")
    if parts[-1] == META:
        return "/" + "/".join(parts[:-1]), None
    for i in range(len(parts) - 1, -1, -1):
        if parts[i] == "c" and all(p.isdigit() for p in parts[i + 1 :]):
            return "/" + "/".join(parts[:i]), [int(p) for p in parts[i + 1 :]]
    raise RepositoryError(f"not a key: {key}")


def cut(data: bytes, start: int = 0, end: int | None = None, last: int | None = None, until: int | None = None) -> bytes:
    """Bytes from start up to end, the last n, or all until the last n."""
    if last is not None:
        return data[max(0, len(data) - last) :]
    return data[: max(0, len(data) - until)] if until is not None else data[start:end]


class Store:
    """Keys of one session.  It writes, deletes and lists; it has no partial writes."""

    supports_writes = supports_deletes = supports_listing = True
    supports_partial_writes = supports_consolidated_metadata = False

    def __init__(self, session: Session):
        self.session = session

    def _document(self, n) -> dict:
        data = json.loads(n.user_data)
        doc = data if "zarr_format" in data else {"zarr_format": 3, "node_type": n.node_type, "attributes": data}
        if n.node_type == "array":
            doc |= {"shape": list(n["shape"]), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(n.chunk_shape)}}}
        return doc

    def get(self, key: str, **byte_range: int) -> bytes | None:
        """The value of a key or a part of it (see cut); None if there is none."""
        path, coord = parsed(key)
        n = self.session.node(path)
        if n is None:
            return None
        if coord is None:
            return cut(json.dumps(self._document(n)).encode(), **byte_range)
        found = self.session.read_chunks(path, [coord]).first() if n.node_type == "array" else None
        return None if found is None else cut(bytes(found.data), **byte_range)

    def get_many(self, keys: list[tuple[str, dict]]) -> list[bytes | None | Exception]:
        """Parts of many keys, in their order: one look at the nodes and one read for each array.
        What goes wrong with a key stands in its place and leaves the others alone."""
        asked: list[tuple | Exception] = []
        for key, _ in keys:
            try:
                asked.append(parsed(key))
            except Exception as e:  # noqa: BLE001
                asked.append(e)
        names = sorted({x[0] for x in asked if not isinstance(x, Exception)})
        nodes = {n.path: n for n in self.session.nodes().where(F.col("path").isin(names)).collect()} if names else {}
        wanted: dict[str, set[tuple]] = {}
        for x in asked:
            if not isinstance(x, Exception) and x[1] is not None and x[0] in nodes and nodes[x[0]].node_type == "array":
                wanted.setdefault(x[0], set()).add(tuple(x[1]))
        data: dict[tuple, bytes] = {}
        failed: dict[str, Exception] = {}
        for path, coords in wanted.items():
            try:
                data |= {(path, tuple(r.coord)): bytes(r.data) for r in self.session.read_chunks(path, [list(c) for c in sorted(coords)]).collect()}
            except Exception as e:  # noqa: BLE001
                failed[path] = e

        def one(x, how: dict) -> bytes | None | Exception:
            if isinstance(x, Exception):
                return x
            path, coord = x
            if path in failed and coord is not None:
                return failed[path]
            whole = json.dumps(self._document(nodes[path])).encode() if coord is None and path in nodes else data.get((path, tuple(coord or ()))) if coord is not None else None
            try:
                return None if whole is None else cut(whole, **how)
            except Exception as e:  # noqa: BLE001
                return e

        return [one(x, how) for x, (_, how) in zip(asked, keys)]

    def exists(self, key: str) -> bool:
        path, coord = parsed(key)
        n = self.session.node(path)
        if n is None or coord is None:
            return n is not None
        return n.node_type == "array" and not self.session.array_chunks(path).where(F.col("coord") == F.array(*[F.lit(c).cast("bigint") for c in coord])).isEmpty()

    def set(self, key: str, value: bytes) -> None:
        path, coord = parsed(key)
        if coord is not None:
            row = self.session.spark.createDataFrame([(coord, bytearray(value))], "coord array<bigint>, data binary")
            self.session.set_chunks(path, row)
            return
        doc = json.loads(value)
        shape = doc.get("shape")
        if self.session.node(path) is not None:
            self.session.update_node(path, doc, shape)
        elif doc["node_type"] == "array":
            self.session.add_array(path, shape, doc["chunk_grid"]["configuration"]["chunk_shape"], doc)
        else:
            self.session.add_group(path, doc)

    def set_if_not_exists(self, key: str, value: bytes) -> None:
        if not self.exists(key):
            self.set(key, value)

    def delete(self, key: str) -> None:
        """Delete a chunk, or a node with all below it; unknown keys are no error."""
        path, coord = parsed(key)
        if coord is None:
            self.session.delete_node(path)
        elif self.exists(key):
            self.session.delete_chunks(path, self.session.spark.createDataFrame([(coord,)], "coord array<bigint>"))

    def delete_dir(self, prefix: str) -> None:
        """Delete the nodes below a prefix, or the chunks of an array below one."""
        path = "/" + prefix.strip("/")
        if self.session.node(path) is not None:
            self.session.delete_node(path)
            return
        parts = path[1:].split("/")
        at = max((i for i, p in enumerate(parts) if p == "c" and all(x.isdigit() for x in parts[i + 1 :])), default=None)
        node = self.session.node("/" + "/".join(parts[:at])) if at is not None else None
        if node is not None and node.node_type == "array":
            lead = [int(x) for x in parts[at + 1 :]]
            below = self.session.array_chunks(node.path).where(F.slice("coord", 1, len(lead)) == F.array(*[F.lit(x).cast("bigint") for x in lead]) if lead else F.lit(True))
            self.session.delete_chunks(node.path, below.select("coord"))

    def clear(self) -> None:
        self.session.delete_node("/")

    def list(self, prefix: str = "") -> DataFrame:
        return self.session.keys(prefix)

    def list_dir(self, prefix: str = "") -> DataFrame:
        """(item, kind): the next component of the keys below a prefix, a key or a prefix; an
        array always shows its `c`."""
        prefix = prefix.strip("/")
        rest = F.substring(F.col("key"), F.lit(len(prefix) + 2 if prefix else 1), F.length("key"))
        items = self.list(prefix).where(F.col("key") != prefix).select(rest.alias("rest"))
        found = items.select(F.split("rest", "/")[0].alias("item"), F.when(F.contains("rest", F.lit("/")), "prefix").otherwise("key").alias("kind"))
        node = self.session.node("/" + prefix)
        if node is not None and node.node_type == "array":
            found = found.union(self.session.spark.createDataFrame([("c", "prefix")], "item string, kind string"))
        return found.distinct()

    def is_empty(self, prefix: str = "") -> bool:
        return self.list(prefix).isEmpty()

    def getsize(self, key: str) -> int:
        path, coord = parsed(key)
        found = self.get(key) if coord is None else self.session.array_chunks(path).where(F.col("coord") == F.array(*[F.lit(c).cast("bigint") for c in coord])).first()
        if found is None:
            raise RepositoryError(f"no {key}")
        return len(found) if coord is None else found["length"]

    def getsize_prefix(self, prefix: str = "") -> int:
        """Bytes of the metadata documents and chunks of the nodes below a prefix."""
        nodes = self.session.nodes()
        if prefix.strip("/"):
            nodes = nodes.where(paths.under(F.col("path"), "/" + prefix.strip("/")))
        chunks = self.session.chunks().join(nodes.select("node_id"), "node_id", "left_semi").agg(F.sum("length")).first()[0] or 0
        return chunks + sum(len(json.dumps(self._document(n))) for n in nodes.toLocalIterator())
