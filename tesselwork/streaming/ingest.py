"""Structured Streaming into a repository: each micro-batch of references is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.repository import Repository


def last_batch(repo: Repository, stream: str, branch: str) -> int:
    """The number of the newest batch of a stream on a branch, -1 if there is none."""
    for info in repo.ancestry(branch=branch):
        if info["metadata"].get("stream") == stream:
            return int(info["metadata"]["batch"])
    return -1


def stream_refs(refs: DataFrame, repo: Repository, array: str, stream: str, checkpoint: str, branch: str = "main", trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of (coord, location, offset, length) to an array.  Commits name their batch,
    and a batch that was committed before a failure is not committed again, so each reference
    is written once.  Commits of others to the branch are rebased over."""

    def commit(batch: DataFrame, number: int) -> None:
        if number <= last_batch(repo, stream, branch):
            return
        session = repo.session(branch)
        session.set_virtual_refs(array, batch)
        session.commit(f"batch {number} of {stream}", metadata={"stream": stream, "batch": str(number)}, rebase=True, allow_empty=True)

    return refs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
