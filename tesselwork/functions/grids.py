"""Chunk-grid arithmetic on array columns, in integers throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b) -> Column:
    """The integer quotient of integers; doubles would round beyond 2**53."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def num_chunks(shape: Column, chunks: Column) -> Column:
    """Chunks along each axis of a regular grid: the quotient rounded up, 0 for a chunk of 0."""
    return F.zip_with(shape, chunks, lambda n, c: F.when(c == 0, F.lit(0).cast("bigint")).otherwise(div(n, c) + F.when(n % c == 0, 0).otherwise(1)))


def num_chunks_rectilinear(sizes: Column) -> Column:
    """Chunks along an axis given as runs (size, count)."""
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x["count"])


def chunk_shape(shape: Column, chunks: Column, coord: Column) -> Column:
    """The extent of the chunk at coord: edge chunks get the remainder."""
    three = F.arrays_zip(shape.alias("n"), chunks.alias("c"), coord.alias("i"))
    return F.transform(three, lambda x: F.greatest(F.lit(0).cast("bigint"), F.least(x["c"], x["n"] - x["c"] * x["i"])))


def valid_coord(coord: Column, counts: Column) -> Column:
    """Whether a coordinate lies in the grid; ranks must agree, and an axis without chunks
    holds index 0 only."""
    inside = F.zip_with(coord, counts, lambda i, n: (i >= 0) & (i <= F.greatest(n, F.lit(1)) - 1))
    return (F.size(coord) == F.size(counts)) & F.forall(inside, lambda x: F.coalesce(x, F.lit(False)))


def shifted(coord: Column, offset: list[int]) -> Column:
    return F.zip_with(coord, F.array(*[F.lit(o).cast("bigint") for o in offset]), lambda i, o: i + o)


def unravel(index: Column, grid: list[int]) -> Column:
    """The coordinate of a C-order position in a grid."""
    out, below = [], 1
    for n in reversed(grid):
        out.append(F.pmod(div(index, below), F.lit(n)).cast("bigint"))
        below *= n
    return F.array(*reversed(out))


def split_bucket(coord: Column, sizes: list[int]) -> Column:
    """The manifest split a coordinate belongs to: each index over its axis's split size."""
    return F.array(*[div(F.element_at(coord, i + 1), s) for i, s in enumerate(sizes)])


def split_of(coord: Column, sizes: Column) -> Column:
    """split_bucket with sizes from a column; an axis whose size is null is one split."""
    return F.zip_with(coord, sizes, lambda i, s: F.coalesce(div(i, s), F.lit(0).cast("bigint")))


def overlap(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """How the box [lo2, hi2) meets [lo, hi): complete if it lies within, partial, or none."""
    within = F.forall(F.zip_with(lo, lo2, lambda a, b: a <= b), lambda x: x) & F.forall(F.zip_with(hi, hi2, lambda a, b: b <= a), lambda x: x)
    meet = F.forall(F.zip_with(lo, hi2, lambda a, b: a < b), lambda x: x) & F.forall(F.zip_with(hi, lo2, lambda a, b: a > b), lambda x: x)
    return F.when(within, "complete").when(meet, "partial").otherwise("none")


def byte_range(data: Column, kind: Column, a: Column, b: Column) -> Column:
    """bounded [a, b), from a, until (all but the last a bytes), last a bytes; null if out of
    bounds."""
    n = F.length(data)
    begin = F.when(kind == "bounded", a).when(kind == "from", a).when(kind == "until", 0).otherwise(n - a)
    end = F.when(kind == "bounded", b).when(kind == "until", n - a).otherwise(n)
    good = (begin >= 0) & (begin <= end) & (end <= n)
    return F.when(good, F.substring(data, begin + 1, end - begin))
