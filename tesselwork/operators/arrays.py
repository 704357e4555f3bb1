"""Operators on the chunks of an array: reindex, shift, splits, extents and dense reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids, paths


def reindex(chunks: DataFrame, forward: Callable[[Column], Column], counts: list[int], clear: bool = False) -> DataFrame:
    """Chunks (coord, ...) moved to forward(coord); a null destination leaves a chunk in place.

    Chunks outside the grid are skipped, a destination outside it raises.  A chunk written to
    a position replaces what is there; vacated positions keep their old chunk unless clear,
    which is what an inverse mapping does."""
    grid = F.array(*[F.lit(n).cast("bigint") for n in counts])
    inside = chunks.where(grids.valid_coord(F.col("coord"), grid))
    to = forward(F.col("coord"))
    checked = F.when(to.isNotNull() & ~grids.valid_coord(to, grid), F.raise_error(F.lit("destination outside the grid"))).otherwise(to)
    moved = inside.withColumn("_to", checked).where("_to is not null").drop("coord").withColumnRenamed("_to", "coord")
    if clear:
        stays = inside.where(to.isNull())
    else:
        stays = inside
    kept = stays.join(moved.select("coord"), "coord", "left_anti")
    return moved.select(chunks.columns).unionByName(kept)


def shift(chunks: DataFrame, offset: list[int], counts: list[int]) -> DataFrame:
    """Chunks moved by an offset; those that leave the grid are dropped, vacated places empty."""
    grid = F.array(*[F.lit(n).cast("bigint") for n in counts])
    inside = chunks.where(grids.valid_coord(F.col("coord"), grid))
    return inside.withColumn("coord", grids.shifted(F.col("coord"), offset)).where(grids.valid_coord(F.col("coord"), grid))


def extents(chunks: DataFrame, keys: tuple[str, ...], rank: int) -> DataFrame:
    """The half-open box of each key's coordinates: lo and hi arrays."""
    axes = [F.element_at("coord", i + 1) for i in range(rank)]
    found = chunks.groupBy(*keys).agg(*[F.min(a).alias(f"_lo{i}") for i, a in enumerate(axes)], *[(F.max(a) + 1).alias(f"_hi{i}") for i, a in enumerate(axes)], F.count("*").alias("n"))
    return found.select(*keys, F.array(*[f"_lo{i}" for i in range(rank)]).alias("lo"), F.array(*[f"_hi{i}" for i in range(rank)]).alias("hi"), "n")


def cells(matrix: DataFrame, row: str, values: str, chunk: tuple[int, int]) -> DataFrame:
    """(ci, cj, i, j, value): elements of a table of vectors, with their chunk."""
    each = matrix.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "value"))
    return each.select(F.floor(F.col("i") / chunk[0]).cast("bigint").alias("ci"), F.floor(F.col("j") / chunk[1]).cast("bigint").alias("cj"), "i", F.col("j").cast("bigint").alias("j"), "value")


def dense_slice(elements: DataFrame, box: list[tuple[int, int]], fill, axes: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """All positions of a box with their values, fill where no element is stored."""
    spark, every = elements.sparkSession, None
    for a, (lo, hi) in zip(axes, box):
        if every is None:
            every = spark.range(lo, hi).select(F.col("id").alias(a))
        elif hi > lo:
            every = every.select("*", F.explode(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi - 1).cast("bigint"))).alias(a))
        else:
            every = every.where("false").withColumn(a, F.lit(0).cast("bigint"))
    inside = elements
    for a, (lo, hi) in zip(axes, box):
        inside = inside.where((F.col(a) >= lo) & (F.col(a) < hi))
    return every.join(inside.select(*axes, "value"), list(axes), "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def append(base: DataFrame, more: DataFrame, axis: str, size: int) -> DataFrame:
    """base with more after it along an axis of that size."""
    return base.unionByName(more.withColumn(axis, F.col(axis) + F.lit(size)))


def flat_refs(refs: DataFrame, position: str, grid: list[int]) -> DataFrame:
    """refs: (position in C order, location, ...) -> with coord; references without a location
    are skipped."""
    return refs.where("location <> ''").withColumn("coord", grids.unravel(F.col(position), grid))


def in_box(chunks: DataFrame, box: list[tuple[int, int]] | None, axes: tuple[str, ...] = ()) -> DataFrame:
    """Chunks (coord, ...) at the positions of a half-open box, all of them without one.  axes
    names columns that repeat the first indices, or are null: filters on those reach a scan."""
    for (lo, hi), a in zip(box or (), axes):
        chunks = chunks.where(F.col(a).isNull() | (F.col(a) >= lo) & (F.col(a) < hi))
    for i, (lo, hi) in enumerate(box or ()):
        at = F.get("coord", F.lit(i))
        chunks = chunks.where((at >= lo) & (at < hi))
    return chunks


def split_sizes(path: Column, rank: Column, rules: list[dict]) -> Column:
    """The split size of each axis of the array at path: that of the first rule (when, axis, size;
    see Repository.set_split_rules) that holds for the axis, null where none does."""

    def of(axis: Column) -> Column:
        found = F.lit(None).cast("bigint")
        for r in reversed(rules):
            holds = paths.holds(path, r.get("when")) & (axis == r["axis"] if r.get("axis") is not None else F.lit(True))
            found = F.when(holds, F.lit(r["size"]).cast("bigint")).otherwise(found)
        return found

    return F.when(rank > 0, F.transform(F.sequence(F.lit(0), rank - 1), of)).otherwise(F.array().cast("array<bigint>"))
