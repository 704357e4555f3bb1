"""Bytes of chunks: inline ones from the manifest, native ones from their payload tables,
virtual ones as byte ranges of objects elsewhere."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECTS = "chunk_id string, node_id string, coord array<bigint>, length bigint, data binary"
#: Bytes a reader of ranges holds before it passes them on.
BATCH_BYTES = 16 << 20


def read_ranges(refs: DataFrame, unchanged_since: datetime | None = None) -> DataFrame:
    """refs (location, offset, length, and perhaps modified) with a column data: those bytes of
    the objects.

    Each task sorts its references by place and keeps one object open, so that no shuffle is
    needed however many chunks one object holds.  A range beyond the object's end raises, as
    does an object written after unchanged_since, or after a reference's own time modified
    (whole seconds)."""
    names, limit, latest = refs.columns, BATCH_BYTES, unchanged_since.timestamp() if unchanged_since else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, source, written = None, None, None
        for batch in batches:
            start, data, held = 0, [], 0
            times = batch.column(names.index("modified")).to_pylist() if "modified" in names else [None] * len(batch)
            for i, (location, offset, length) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in ("location", "offset", "length")))):
                if location != place:
                    system, path = fs.FileSystem.from_uri(location)
                    place, source, written = location, system.open_input_file(path), None
                if latest is not None or times[i] is not None:
                    written = written or system.get_file_info(path).mtime.timestamp()
                    if latest is not None and written > latest or times[i] is not None and int(written) > times[i]:
                        raise ValueError(f"{location} has changed")
                found = source.read_at(length, offset)
                if len(found) != length:
                    raise ValueError(f"{location} ends before {offset + length}")
                data.append(found)
                held += length
                if held >= limit:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(data)).columns, pa.array(data, pa.binary())], names=[*names, "data"])
                    start, data, held = i + 1, [], 0
            if data:
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(data)).columns, pa.array(data, pa.binary())], names=[*names, "data"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema)
    return refs.sortWithinPartitions("location", "offset").mapInArrow(run, f"{head}, data binary")


def write_objects(native: DataFrame, root: str, table: str) -> DataFrame:
    """Write the payloads of native rows as one table; returns their manifest rows, read from
    what was written, so that both agree."""
    key = F.sha1(F.concat_ws("/", F.lit(table), "node_id", F.col("coord").cast("array<string>")))
    native.select(key.alias("chunk_id"), "node_id", "coord", "length", F.col("inline").alias("data")).write.parquet(f"{root}/{table}")
    wrote = native.sparkSession.read.schema(OBJECTS).parquet(f"{root}/{table}")
    return wrote.select("node_id", "coord", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("inline"), "chunk_id", F.lit(table).alias("location"), F.lit(0).cast("bigint").alias("offset"), "length", F.lit(None).cast("bigint").alias("modified"), F.lit(False).alias("deleted"))


def with_data(chunks: DataFrame, root: str, unchanged_since: datetime | None = None) -> DataFrame:
    """(coord, data) of chunk rows of every kind."""
    spark = chunks.sparkSession
    here = chunks.where("kind = 3 or kind = 1 and inline is not null").select("coord", F.col("inline").alias("data"))
    stored = chunks.where("kind = 1 and inline is null")
    tables = [r[0] for r in stored.select("location").distinct().collect()]  # one a commit with native chunks
    if tables:
        objects = spark.read.schema(OBJECTS).parquet(*[f"{root}/{t}" for t in tables])
        here = here.unionByName(stored.select("coord", "chunk_id").join(objects.select("chunk_id", "data"), "chunk_id").select("coord", "data"))
    virtual = chunks.where("kind = 2").select("coord", "location", "offset", "length", "modified")
    return here.unionByName(read_ranges(virtual, unchanged_since).select("coord", "data"))
