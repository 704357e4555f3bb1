"""Command line: python -m tesselwork.cli create|ancestry|graph|branch|tag|inspect PATH ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .sources import display
from .sources.repository import Repository


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tesselwork")
    does = out.add_subparsers(dest="what", required=True)
    for name in ("create", "ancestry", "graph", "inspect", "ops"):
        p = does.add_parser(name)
        p.add_argument("path")
        if name in ("ancestry", "inspect"):
            p.add_argument("--branch")
            p.add_argument("--tag")
            p.add_argument("--snapshot")
    for name in ("branch", "tag"):
        p = does.add_parser(name)
        p.add_argument("action", choices=("list", "create", "delete"))
        p.add_argument("path")
        p.add_argument("name", nargs="?")
        p.add_argument("snapshot", nargs="?")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run one command; returns what it prints."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.what == "create":
        Repository.create(spark, a.path)
        return f"created {a.path}"
    repo = Repository.open(spark, a.path)
    version = {k: v for k, v in (("branch", getattr(a, "branch", None)), ("tag", getattr(a, "tag", None)), ("snapshot_id", getattr(a, "snapshot", None))) if v}
    if a.what == "ancestry":
        return "\n".join(f"{s['id']} {s['message']}" for s in repo.ancestry(**version))
    if a.what == "graph":
        return display.graph(repo)
    if a.what == "ops":
        return "\n".join(o["type"] for o in repo.ops_log())
    if a.what == "inspect":
        return display.inspect_snapshot(repo, repo.resolve(**version))
    if a.action == "list":
        return "\n".join(repo.list_branches() if a.what == "branch" else repo.list_tags())
    if not a.name:
        raise SystemExit("a name is needed")
    if a.action == "create":
        (repo.create_branch if a.what == "branch" else repo.create_tag)(a.name, a.snapshot or repo.resolve())
    else:
        (repo.delete_branch if a.what == "branch" else repo.delete_tag)(a.name)
    return f"{a.what} {a.name}: {a.action}d"


if __name__ == "__main__":
    print(main())
