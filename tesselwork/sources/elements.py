"""Arrays written and read by element: (index array<bigint>, value double) to and from the
chunks of a session, each a block of little-endian numbers in C order.

A chunk is put together in one task, which its size bounds; elements meet the chunk that is
there already by a cogrouped shuffle on the chunk's coordinate, so appends and regions need not
lie on chunk borders.  Elements given twice: the greatest value stays, NaN above all.  Null
values are stored as the fill value.  Indices outside the array raise.  Values travel as doubles,
so integers beyond 2**53 are rounded."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids
from . import repository
from .repository import RepositoryError, Session

DTYPES = ("<f8", "<f4", "<i8", "<i4", "<i2", "|i1", "|u1")
#: Elements that decoding hands on at a time.
BATCH = 100_000


def create(session: Session, path: str, shape: list[int], chunk_shape: list[int], dtype: str = "<f8", fill: float = 0.0) -> None:
    """An array whose elements write() and read() know how to store."""
    if dtype not in DTYPES or len(shape) != len(chunk_shape) or any(c < 1 for c in chunk_shape):
        raise RepositoryError("unknown type of elements, or shapes that do not fit")
    session.add_array(path, shape, chunk_shape, {"dtype": dtype, "fill": fill})


def _stored(session: Session, path: str):
    n = session._array(path)
    kind = json.loads(n.user_data)
    if "dtype" not in kind:
        raise RepositoryError(f"{path} does not say how its elements are stored")
    return n, np.dtype(kind["dtype"]), kind["fill"]


def _chunk_of(index: Column, chunk: list[int]) -> Column:
    return F.array(*[grids.div(index[i], c) for i, c in enumerate(chunk)])


def _place(index: Column, chunk: list[int]) -> Column:
    """The C-order position of an index within its chunk."""
    at = F.lit(0).cast("bigint")
    for i, c in enumerate(chunk):
        at = at * c + index[i] % c
    return at


def write(session: Session, path: str, elements: DataFrame, start: list[int] | None = None) -> None:
    """Set elements, their indices counted from start; the others keep their values."""
    n, dtype, fill = _stored(session, path)
    shape, chunk = list(n["shape"]), list(n.chunk_shape)
    start = start or [0] * len(shape)
    index = F.transform("index", lambda x, i: x + F.array(*[F.lit(s).cast("bigint") for s in start])[i]) if any(start) else F.col("index")
    moved = elements.select(index.alias("index"), F.coalesce(F.col("value").cast("double"), F.lit(float(fill))).alias("value"))
    bounds = F.array(*[F.lit(s).cast("bigint") for s in shape])
    inside = (F.size("index") == len(shape)) & F.forall(F.zip_with("index", bounds, lambda i, s: (i >= 0) & (i < s)), lambda x: F.coalesce(x, F.lit(False)))
    checked = moved.withColumn("index", F.when(F.coalesce(inside, F.lit(False)), F.col("index")).otherwise(F.raise_error(F.lit("index outside the array")).cast("array<bigint>")))
    placed = checked.groupBy(_chunk_of(F.col("index"), chunk).alias("coord"), _place(F.col("index"), chunk).alias("at")).agg(F.max("value").alias("value"))
    size = int(np.prod(chunk))

    def build(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if new.empty:
            return pd.DataFrame({"coord": [], "data": []})
        block = np.frombuffer(old["data"].iloc[0], dtype).copy() if len(old) else np.full(size, fill, dtype)
        block[new["at"].to_numpy()] = new["value"].to_numpy().astype(dtype)
        return pd.DataFrame({"coord": [new["coord"].iloc[0]], "data": [block.tobytes()]})

    # only chunks that are written to are fetched
    there = session.array_chunks(path).join(placed.select("coord").distinct(), "coord", "left_semi")
    old = repository.payloads.with_data(there, session.repo.path)
    session.set_chunks(path, placed.groupBy("coord").cogroup(old.groupBy("coord")).applyInPandas(build, "coord array<bigint>, data binary"))


def append(session: Session, path: str, elements: DataFrame, axis: int, length: int) -> None:
    """Lengthen an array by length along an axis and set elements there, their indices counted
    from the old end."""
    n, _, _ = _stored(session, path)
    start = [0] * len(n["shape"])
    start[axis] = n["shape"][axis]
    session.update_node(path, shape=[s + (length if i == axis else 0) for i, s in enumerate(n["shape"])])
    write(session, path, elements, start)


def read(session: Session, path: str, box: list[tuple[int, int]] | None = None) -> DataFrame:
    """(index, value) of the stored chunks' elements, or of those in a half-open box; chunks
    never written give no rows (operators.arrays.dense_slice fills them in).  Only chunks that
    meet the box are fetched."""
    n, dtype, _ = _stored(session, path)
    shape, chunk = list(n["shape"]), list(n.chunk_shape)
    box = [(max(lo, 0), min(hi, s)) for (lo, hi), s in zip(box or [(0, s) for s in shape], shape)]
    met = [(lo // c, -(-hi // c)) for (lo, hi), c in zip(box, chunk)]
    chunks = repository.payloads.with_data(session.array_chunks(path, met), session.repo.path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for coord, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = np.frombuffer(data.as_py(), dtype)
                for first in range(0, len(block), BATCH):
                    part = block[first : first + BATCH]
                    at = np.stack(np.unravel_index(np.arange(first, first + len(part)), chunk), 1) + np.multiply(coord, chunk)
                    good = np.all([(at[:, i] >= lo) & (at[:, i] < hi) for i, (lo, hi) in enumerate(box)], axis=0)
                    at, part = at[good], part[good]
                    index = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, len(chunk)), pa.int32()), pa.array(at.ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([index, pa.array(part.astype("f8"), pa.float64())], names=["index", "value"])

    return chunks.select("coord", "data").mapInArrow(run, "index array<bigint>, value double")
