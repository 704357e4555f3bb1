"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its segments, a point of a small grid.
The Manhattan distance of two points never exceeds the Hamming distance of their
fingerprints, so fingerprints within two bits lie within distance two in the grid, and two
such points always share a grid cell at distance at most one from both.  Every distinct
fingerprint is therefore placed in its own cell and the neighbouring ones; those that meet in
a cell of few fingerprints are the pairs of the range join, verified by counting differing
bits.  A crowded cell lists no pairs: fingerprints whose balls of radius one share a bit
string are within two bits of each other, and conversely, and one such ball key is held by 65
fingerprints at most, so a link table is linear in the candidates however large a group of
near copies is.  Components of the links are found by stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, components, lean, materialize
from ._text import Words, mix, text_chunks, word_table

#: 20 segments of three bits and one of four.
SEGMENTS = 21
#: Fingerprints of a cell up to which its pairs are listed.
FEW = 16


def _fingerprints(column: pa.Array, shingle: int, seed: int) -> np.ndarray:
    table, digest = word_table("lower"), xxhash.xxh64_intdigest
    out = np.zeros(len(column), np.uint64)
    for a, b, data, offsets in text_chunks(column):
        words = Words(data, offsets, table)
        joined, start, end = words.joined()
        raw = joined.tobytes()
        n = np.where(words.count >= shingle, words.count - shingle + 1, np.minimum(words.count, 1))
        first = np.zeros(b - a + 1, np.int64)
        np.cumsum(n, out=first[1:])
        total = int(first[-1])
        if not total:
            continue
        at = np.arange(total) - np.repeat(first[:-1], n) + np.repeat(words.first[:-1], n)
        last = np.minimum(at + shingle, np.repeat(words.first[1:], n)) - 1
        h = np.fromiter((digest(raw[s:e], seed) for s, e in zip(start[at].tolist(), end[last].tolist())), np.uint64, total)
        bits = np.unpackbits(h.view(np.uint8).reshape(total, 8), axis=1, bitorder="little")
        full = np.flatnonzero(n)
        counts = np.add.reduceat(bits, first[full], axis=0, dtype=np.int64)
        over = (2 * counts > n[full, None]).astype(np.uint8)
        out[a + full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


_ONES = np.uint64(0x0101010101010101)


def sketches(hashes: np.ndarray, n: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One SimHash for each row and factor, of n[i] > 0 hashes a row: a bit is set if it is set
    in over half of the row's hashes, as spread by the factor.  Up to 255 hashes are summed for
    eight bits at once, in the bytes of one integer, so bit 8 * j + i is bit 8 * i + j of the
    hashes."""
    first = np.cumsum(n) - n
    runs = -(-n // 255)
    opens = np.cumsum(runs) - runs
    at = (np.arange(int(runs.sum())) - np.repeat(opens, runs)) * 255 + np.repeat(first, runs)
    out, sums = np.empty((len(n), len(factors)), np.uint64), np.empty((len(at), 8), np.uint64)
    for k, factor in enumerate(factors):
        spread = mix(hashes * factor)
        for j in range(8):
            sums[:, j] = np.add.reduceat((spread >> np.uint64(j)) & _ONES, at)
        counts = np.add.reduceat(sums.view(np.uint8), opens, axis=0, dtype=np.int64)
        out[:, k] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) per row: the SimHash of the text's word shingles, 0 for no words.

    Words are runs of other than white space, A-Z lowered; shingles are joined by a space and
    hashed with XXH64; a bit is set if it is set in over half of the shingles, repeats
    included.  A null or blank text has fingerprint zero; repeated rows stay."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _fingerprints(batch.column(1), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"id {kind}, fp long")


def _segments(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments."""
    bounds = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def grid_cells(fp: F.Column, segments: int = SEGMENTS) -> F.Column:
    """The array of cell keys of a fingerprint: its own popcount cell and all at Manhattan
    distance one.  A cell's key is the sum of its coordinates in a mixed radix, which is exact
    for 21 segments or more in 64 bits and otherwise only merges cells, never splits one."""
    parts = [(F.bit_count(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1))).cast("long"), w) for a, w in _segments(segments)]
    own, radix, steps = F.lit(0).cast("long"), 1, []
    for count, width in parts:
        own = own + count * F.lit(radix)
        steps += [F.when(count < width, F.lit(radix)), F.when(count > 0, F.lit(-radix))]
        radix *= width + 1
    if radix >= 1 << 63:
        raise ValueError("too many segments for a 64-bit cell key")
    moves = F.array_append(F.array_compact(F.array(*steps)), F.lit(0).cast("long"))
    return F.transform(moves, lambda d: d + F.col("_own")), own


def near_links(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fp within two bits.

    fps: distinct fp (long).  Every linked pair is really within two bits, and any two
    fingerprints within two bits are joined directly or through one more link."""
    cells_of, own = grid_cells(F.col("fp"), segments)
    cells = fps.withColumn("_own", own).select("fp", F.explode(cells_of).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes an explode as its input, so it would broadcast cells, some forty rows a fingerprint
    shared = materialize(cells.join(sizes.hint("merge"), "cell"), "simhash-cells")
    few = shared.where(F.col("n") <= FEW).groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    few = few.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
    few = few.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    crowded = shared.where(F.col("n") > FEW).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)])
    balls = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("ball"))
    held = balls.groupBy("ball").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return few.union(held.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 3, seed: int = 42, segments: int = SEGMENTS) -> DataFrame:
    """(id, fp, component) per row of docs, component being the smallest id reachable over
    links between fingerprints that differ in two bits or fewer.

    Copies with one fingerprint meet as one vertex.  Rows with a null id take part in links
    but never name a component (null if no row of it has an id).  An empty table gives none."""
    rows = materialize(fingerprints(docs, text, id, shingle, seed), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    member = components(near_links(distinct.select("fp"), segments), "simhash-cc")
    joined = distinct.join(member, distinct.fp == member.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    joined = materialize(joined, "simhash-members")
    names = joined.groupBy("c").agg(F.min("low").alias("component"))
    named = joined.join(names, "c").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def fingerprint_hex(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
