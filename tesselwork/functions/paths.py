"""Node paths and store keys as column expressions; paths are absolute, the root is "/"."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CANONICAL = re.compile(r"/|(/(?!\.{1,2}(/|$))[^/]+)+")


def valid_path(path: str) -> bool:
    """Whether a path is absolute and canonical."""
    return bool(_CANONICAL.fullmatch(path))


def parent(path: Column) -> Column:
    """The path above, null for the root."""
    up = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(path == "/", None).when(up == "", "/").otherwise(up)


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def depth(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1)


def ancestors(path: Column) -> Column:
    """All proper ancestors, nearest first, the root last."""
    parts = F.split(path, "/")
    steps = F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))
    above = F.transform(steps, lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(path == "/", F.array().cast("array<string>")).otherwise(above)


def under(path: Column, prefix: str) -> Column:
    """Whether path is prefix or below it, matching whole components."""
    if prefix in ("", "/"):
        return F.lit(True)
    return (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def holds(path: Column, condition: dict | None) -> Column:
    """Whether a condition holds for a path: {"path": regex} and {"name": regex}, found anywhere
    in the path or its last part, {"and": [...]}, {"or": [...]}; None holds for all."""
    if condition is None:
        return F.lit(True)
    if len(condition) != 1:
        raise ValueError("a condition has one of path, name, and, or")
    (kind, what), out = next(iter(condition.items())), None
    if kind in ("path", "name"):
        return (path if kind == "path" else name(path)).rlike(what)
    if kind not in ("and", "or"):
        raise ValueError(f"unknown condition {kind}")
    for c in what:
        one = holds(path, c)
        out = one if out is None else out & one if kind == "and" else out | one
    return F.lit(kind == "and") if out is None else out


def patterns(condition: dict | None) -> list[str]:
    """The regular expressions of a condition."""
    out = []
    for what in (condition or {}).values():
        out += [what] if isinstance(what, str) else [p for c in what for p in patterns(c)]
    return out


def rebased(path: Column, source: str, target: str) -> Column:
    """The path after a move of source (with all below it) to target."""
    return F.when(under(path, source), F.concat(F.lit(target), F.substring(path, F.lit(len(source) + 1), F.length(path)))).otherwise(path)


def metadata_key(path: Column) -> Column:
    return F.when(path == "/", F.lit("zarr.json")).otherwise(F.concat(F.substring(path, F.lit(2), F.length(path)), F.lit("/zarr.json")))


def chunk_key(path: Column, coord: Column) -> Column:
    """path/c/i/j; a scalar array's only chunk is path/c."""
    relative = F.substring(path, F.lit(2), F.length(path))
    return F.concat_ws("/", F.when(relative != "", relative), F.lit("c"), F.when(F.size(coord) > 0, F.array_join(coord.cast("array<string>"), "/")))


def parse_key(key: Column) -> Column:
    """struct(kind, path, coord) of a store key: metadata, chunk (split at the last c), or
    unknown with nulls.  The key is split once; digits from its end are counted."""
    parts = F.split(key, "/")

    def read(p: Column) -> Column:
        n = F.size(p)
        # digits at the end, from the last part backwards
        tail = F.aggregate(F.reverse(p), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct((a["n"] + F.when(a["go"] & x.rlike(r"^\d+$"), 1).otherwise(0)).alias("n"), (a["go"] & x.rlike(r"^\d+$")).alias("go")))["n"]
        return F.struct(F.element_at(p, -1).alias("last"), p.alias("p"), n.alias("n"), tail.alias("tail"))

    def parsed(r: Column) -> Column:
        p, n, tail = r["p"], r["n"], r["tail"]
        meta = r["last"] == "zarr.json"
        chunk = (tail < n) & (F.get(p, n - tail - 1) == "c")
        above = F.when(meta, n - 1).otherwise(n - tail - 1)
        known = F.coalesce(meta | chunk, F.lit(False))
        path = F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), F.greatest(above, F.lit(0))), "/"))
        coord = F.slice(p, n - tail + 1, tail).cast("array<bigint>")
        return F.struct(F.when(meta, "metadata").when(chunk, "chunk").otherwise("unknown").alias("kind"), F.when(known, path).alias("path"), F.when(chunk & ~meta, coord).alias("coord"))

    return F.transform(F.transform(F.array(parts), read), parsed)[0]
