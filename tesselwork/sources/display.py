"""Drawings of a repository's history, and its parts as JSON."""

from __future__ import annotations

import json
from html import escape

from .repository import Repository


def lanes(repo: Repository) -> list[tuple[str, int, list[int], list[str]]]:
    """(snapshot, its lane, lanes in use beside it, names) of all that branches and tags reach,
    newest first."""
    r = repo.record
    named: dict[str, list[str]] = {}
    for kind in ("branches", "tags"):
        for name, s in sorted(r[kind].items()):
            named.setdefault(s, []).append(name)
    reached = {s for tip in named for s in repo._chain(r, tip)}
    out, waiting = [], []  # waiting: the snapshot each lane leads to, or None
    for s in sorted(reached, key=lambda s: (-r["snapshots"][s]["at"], s)):
        if s not in waiting:
            waiting = [s if w is None and s not in waiting[:i] else w for i, w in enumerate(waiting)] if None in waiting else [*waiting, s]
            first = waiting.index(s)
            waiting = [None if w == s and i != first else w for i, w in enumerate(waiting)]
        lane = waiting.index(s)
        out.append((s, lane, [i for i, w in enumerate(waiting) if w is not None], named.get(s, [])))
        waiting = [None if w == s else w for w in waiting]
        waiting[lane] = r["snapshots"][s]["parent"]
    return out


def graph(repo: Repository, color: bool = False) -> str:
    """The history as text, a snapshot a line."""
    info, lines = repo.record["snapshots"], []
    for s, lane, used, names in lanes(repo):
        marks = " ".join("*" if i == lane else "|" if i in used else " " for i in range(max(used) + 1))
        label = f" ({', '.join(names)})" if names else ""
        lines.append(f"{marks} \033[33m{s}\033[0m{label} {info[s]['message']}" if color else f"{marks} {s}{label} {info[s]['message']}")
    return "\n".join(lines)


def svg(repo: Repository) -> str:
    """The history as a picture."""
    rows = lanes(repo)
    info, at = repo.record["snapshots"], {s: (20 + 20 * lane, 20 + 24 * i) for i, (s, lane, _, _) in enumerate(rows)}
    wide = 40 + 20 * max((lane for _, lane, _, _ in rows), default=0)
    parts = [f'<line x1="{at[s][0]}" y1="{at[s][1]}" x2="{at[p][0]}" y2="{at[p][1]}" stroke="gray"/>' for s, _, _, _ in rows if (p := info[s]["parent"]) in at]
    for s, _, _, names in rows:
        x, y = at[s]
        parts.append(f'<circle cx="{x}" cy="{y}" r="5"/><text x="{wide}" y="{y + 4}">{escape(" ".join([s, *[f"({n})" for n in names], info[s]["message"]]))}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide + 600}" height="{40 + 24 * len(rows)}">{"".join(parts)}</svg>'


def inspect_repository(repo: Repository) -> str:
    return json.dumps(repo.record, indent=2)


def inspect_snapshot(repo: Repository, snapshot_id: str) -> str:
    """A snapshot with its nodes; chunks as counts and bytes of each kind."""
    from pyspark.sql import functions as F

    nodes = [json.loads(r[0]) for r in repo.nodes(snapshot_id).orderBy("path").select(F.to_json(F.struct("*"))).collect()]
    sizes = repo.chunks(snapshot_id).groupBy("node_id", "kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).orderBy("node_id", "kind").collect()
    return json.dumps({"id": snapshot_id} | repo.record["snapshots"][snapshot_id] | {k: repo.tables(snapshot_id, k) for k in ("manifests", "nodes")} | {"tree": nodes, "chunks": [r.asDict() for r in sizes]}, indent=2)


def inspect_transaction(repo: Repository, snapshot_id: str) -> str:
    changed = repo._tx([snapshot_id], "nodes", "change string, node_id string").orderBy("change", "node_id").collect()
    chunks = repo._tx([snapshot_id], "chunks", "node_id string, coord array<bigint>").groupBy("node_id").count().orderBy("node_id").collect()
    return json.dumps({"id": snapshot_id, "nodes": [r.asDict() for r in changed], "updated_chunks": {r.node_id: r["count"] for r in chunks}}, indent=2)
