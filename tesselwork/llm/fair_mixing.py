"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a document's virtual finish time is the
source's words up to and including it, over the source's target.  Read in the order of
finish times, all sources advance in proportion to their targets; the mix is that order cut
at the total budget.  Sources with a target above their size go round again.

Both orders are cut into ranges: the documents by source and shuffle hash for the sums within
a source, and the entries of the queue, ties and all, by finish time for the sums over the
whole.  Rows are summed inside their range, and the ranges' totals, one row each, give what
stands before them; so a source with most of the rows, or very many with one finish time, are
spread over many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import in_ranges, materialize

#: Weights by rank of the source, repeating (fixed values).
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.0, max_repeats: int = 3, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes: (source, source_size), one row a source -> (source, source_size, target).

    Sources take the weights in code-point order, null last.  Targets share `share` of all
    sizes by weight; a target stops at max_repeats times its source and the excess is shared
    again by weight among the rest until none is above."""
    ranged = in_ranges(sizes.select("source", "source_size"), [F.col("source").asc_nulls_first()], "mix-ranges")
    # nulls lie in the first range and come last: all ranks before theirs are those of named sources
    named = ranged.where("source is not null")
    counts = named.groupBy("_part").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("source")) - 1
    placed = named.withColumn("n", inside).join(starts, F.col("_part") == F.col("_p")).select("source", "source_size", (F.col("start") + F.col("n")).alias("rank"))
    unnamed = ranged.where("source is null").select("source", "source_size", F.lit(named.count()).cast("long").alias("rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = materialize(placed.union(unnamed).select("source", "source_size", weight.alias("weight")), "mix-sources")
    budget = float(t.agg(F.sum("source_size")).first()[0] or 0) * share
    cap, level = F.col("source_size") * float(max_repeats), None
    while True:
        held = F.lit(False) if level is None else F.col("weight") * level > cap
        row = t.agg(F.sum(F.when(held, cap).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).first()
        free = float(row[1] or 0)
        now = (budget - float(row[0] or 0)) / free if free > 0 else float("inf")
        if level is not None and now <= level:
            break
        level = now
        if free == 0:
            break
    return t.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def fair_mix(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", share: float = 1.0, max_repeats: int = 3, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix", size: Callable[[Column], Column] = word_count, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, repeats (times the mix takes it),
    taken (size times repeats), finish (its first virtual finish time, by which the mix can be
    read in order; null if it is not taken), source, and the columns named in keep (not materialised twice: name
    small ones only).

    A null text has size 0 and is never taken; a null source is a source of its own.  Rows
    with equal ids are separate documents; the order of equal rows does not change the
    result.  Reruns agree: nothing depends on the partitioning."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id).cast("string"), F.md5(F.col(text).cast("string").cast("binary"))))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"), size(F.col(text)).alias("size"), F.substring(key, 1, 16).alias("key"), *keep)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    stats = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-stats")
    targets = source_targets(stats, share, max_repeats, weights)

    named = rows.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    by = [F.col("key").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("_row").asc()]
    ranged = in_ranges(named, [F.col("s").asc(), *by], "mix-shuffled")
    totals = ranged.groupBy("s", "_part").agg(F.sum("size").alias("t"))
    before = Window.partitionBy("s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("s", "_part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("upto", F.sum("size").over(inside)).join(totals, ["s", "_part"])
    shares = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("s"), "source_size", "target")
    queue = summed.withColumn("cum", F.col("upto") + F.col("base")).join(shares, "s")
    queue = materialize(queue.select("doc_id", "source", "size", "source_size", "target", "key", "cum", "_row", *keep), "mix-queue")

    rounds = range(max_repeats)
    finish = [(F.col("cum") + F.col("source_size") * float(e)) / F.col("target") for e in rounds]
    open_ = [(F.col("size") > 0) & (F.col("target") > 0) & ((F.col("source_size") * float(e) <= F.col("target")) | F.lit(e == 0)) for e in rounds]
    entries = queue.where((F.col("size") > 0) & (F.col("target") > 0)).select(
        "size", "source", "key", "doc_id", "_row", F.explode(F.array(*[F.when(o, F.struct(F.lit(e).alias("round"), f.alias("finish"))) for e, o, f in zip(rounds, open_, finish)])).alias("e")
    ).where("e is not null").select("size", "source", "key", "doc_id", "_row", "e.round", "e.finish")
    budget = int((stats.agg(F.sum("source_size")).first()[0] or 0) * share)
    cut = _cut(entries, budget)
    taken = F.lit(0).cast("long")
    for e, o, f in zip(rounds, open_, finish):
        taken = taken + F.when(o & _before(f, e, cut), 1).otherwise(0)
    mixed = queue.withColumn("repeats", taken.cast("int"))
    mixed = mixed.withColumn("finish", F.when(F.col("repeats") > 0, finish[0]))
    return mixed.select("doc_id", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), "finish", "source", *[c for c in keep if c != "source"])


def _order(finish: Column, round_: Column) -> list[Column]:
    """The queue's order: finish time, ties by source (null last), round, shuffle key, id, size
    and row."""
    return [finish, F.coalesce(F.concat(F.lit("a"), "source"), F.lit("b")), round_, F.col("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"), F.col("_row")]


def _before(finish: Column, round_: int, cut: tuple | None) -> Column:
    """Whether the entry stands at or before the cut in the queue's order."""
    if cut is None:
        return F.lit(True)
    if not cut:
        return F.lit(False)
    out = F.lit(True)
    for mine, limit in reversed(list(zip(_order(finish, F.lit(round_)), cut))):
        out = (mine < F.lit(limit)) | ((mine == F.lit(limit)) & out)
    return out


def _cut(entries: DataFrame, budget: int) -> tuple | None:
    """The last entry of the queue whose running sum of sizes is within the budget: () if there
    is none, None if all are."""
    total = entries.agg(F.sum("size")).first()[0] or 0
    if total <= budget:
        return None
    order = _order(F.col("finish"), F.col("round"))
    sorted_ = in_ranges(entries, order, "mix-sorted")
    # one row a range on the driver: where the budget runs out
    spent, last = 0, None
    for part, size in sorted(sorted_.groupBy("_part").agg(F.sum("size")).collect()):
        if spent + size > budget:
            break
        spent, last = spent + size, part
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = sorted_.where(F.col("_part") == part).withColumn("sum", F.sum("size").over(inside)).where(F.col("sum") + F.lit(spent) <= F.lit(budget))
    for found in (at, sorted_.where(F.col("_part") == (last if last is not None else -1))):
        row = found.agg(F.max(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]))).first()[0]
        if row is not None:
            return tuple(row)
    return ()
