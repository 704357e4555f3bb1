"""Benchmark decontamination by a hash set of normalised n-grams.

Items are cut into windows of n words (an item with fewer words is one window).  While their
size is within `broadcast_bytes` the windows travel to every task as sorted hashes with their
words; beyond it document windows whose leading bits some item window has meet the item windows in a
shuffled join on the hash.
Every hit is verified word by word, and ends as word spans and byte spans of the document."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, lean, materialize
from ._text import Ranges, Words, text_chunks, word_table

#: Item text up to which the windows are broadcast: a worker's index takes about 100 times that.
BROADCAST_BYTES = 2 << 20

_ANY_WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"
#: Bits of the map of item window hashes that spares document windows the shuffle.
_MAP_BITS = 24

_HITS = "n_words long, n_hit long, items array<{0}>, words array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>"


def _item_windows(column: pa.Array, n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, words of the window, hash, words joined by a space)"""
    table = word_table("alnum")
    for a, b, data, offsets in text_chunks(column):
        w = Words(data, offsets, table)
        joined, start, end = w.joined()
        raw, ranges = joined.tobytes(), Ranges(w.hashes())
        for row in range(b - a):
            lo, hi = int(w.first[row]), int(w.first[row + 1])
            size = min(n, hi - lo)
            if size:
                at = np.arange(lo, hi - size + 1)
                for i, h in zip(at.tolist(), ranges.hash(at, at + size).tolist()):
                    yield a + row, size, h, raw[start[i] : end[i + size - 1]]


class _Index:
    """Windows of items by size: sorted hashes, a bit per leading 16 bits, and for each hash
    the words and items of its windows."""

    def __init__(self, windows: list[tuple[object, int, int, bytes]]):
        by_size: dict[int, dict[int, dict[bytes, list]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for item, size, h, words in windows:
            at = by_size[size][h][words]
            if not at or at[-1] != item:
                at.append(item)
        self.sizes = {}
        for size, found in by_size.items():
            keys = np.array(sorted(found), np.uint64)
            lead = np.zeros(1 << 20, bool)
            lead[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.sizes[size] = keys, lead, {h: list(v.items()) for h, v in found.items()}


def _scan(column: pa.Array, index: _Index) -> Iterator[tuple[int, int, list, list, list]]:
    """Per row: words, words hit, item ids in order, spans in words and in bytes."""
    table = word_table("alnum")
    for a, b, data, offsets in text_chunks(column):
        w = Words(data, offsets, table)
        ranges = Ranges(w.hashes())
        hits: dict[int, list] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        for size, (keys, lead, found) in index.sizes.items():
            h = ranges.windows(size)
            if not len(h):
                continue
            at = np.flatnonzero(lead[(h >> np.uint64(44)).astype(np.int64)] & (w.doc[: len(h)] == w.doc[size - 1 :]))
            at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
            for i in at.tolist():
                row = int(w.doc[i])
                text = b" ".join(w.norm[s:e].tobytes() for s, e in zip(w.start[i : i + size].tolist(), w.end[i : i + size].tolist()))
                for words, ids in found[int(h[i])]:
                    if words == text:
                        hits[row].append((i, i + size))
                        items[row].update(ids)
        for row in range(b - a):
            yield int(w.count[row]), *_merged(hits.get(row, ()), items.get(row, ()), w, row, int(offsets[row]))


def _merged(hits: list, items: set, w: Words, row: int, begin: int) -> tuple[int, list, list, list]:
    spans: list[list[int]] = []
    for s, e in sorted(hits):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    first = int(w.first[row]) if spans else 0
    words = [{"start": s - first, "end": e - first} for s, e in spans]
    cut = [{"start": int(w.start[s]) - begin, "end": int(w.end[e - 1]) - begin} for s, e in spans]
    return sum(e - s for s, e in spans), sorted(items), words, cut


def _report(ids: list[pa.Array], names: list[str], rows: list, kind: pa.DataType) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = [pa.int64(), pa.int64(), pa.list_(kind), span, span]
    return pa.RecordBatch.from_arrays(ids + [pa.array(list(c), t) for c, t in zip(cols, types)], names=names + ["n_words", "n_hit", "items", "words", "spans"])


def contamination(docs: DataFrame, items: DataFrame, n: int = 8, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (ids of the items with a window in it, in
    order), words and spans (merged hit ranges in words and in UTF-8 bytes), and the columns
    named in keep.

    Words are runs of 0-9, a-z and characters beyond ASCII after lowering A-Z.  Null, empty
    and wordless texts hit nothing, on either side; items with a null id are ignored; repeated
    items count once."""
    spark = docs.sparkSession
    bounded_batches(spark)
    benchmark = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null").where(F.col("text").rlike(_ANY_WORD)).dropDuplicates()
    size = benchmark.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(docs, benchmark, n, text, id, keep)
    rows = benchmark.collect()
    windows = [(rows[r].item, k, h, words) for r, k, h, words in _item_windows(pa.array([r.text for r in rows], pa.string()), n)]
    windows.sort(key=lambda x: x[0])
    shared = spark.sparkContext.broadcast(windows)
    kind = benchmark.schema["item"].dataType
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        index = _Index(shared.value)
        at = [i for i in range(2 + len(keep)) if i != 1]
        for batch in batches:
            yield _report([batch.column(i) for i in at], ["doc_id", *keep], list(_scan(batch.column(1), index)), to_arrow_type(kind))

    head = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return source.mapInArrow(lean(run), f"{head}, {_HITS.format(kind.simpleString())}")


def _joined(docs: DataFrame, benchmark: DataFrame, n: int, text: str, id: str, keep: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark too large to broadcast: item windows and document windows meet
    by hash, and the windows found travel to their documents, each in a small index."""
    spark = docs.sparkSession
    kind = benchmark.schema["item"].dataType
    name = kind.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_item_windows(batch.column(1), n))
            at = pa.array([x[0] for x in found], pa.int64())
            h = np.array([x[2] for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(at), pa.array([x[1] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.binary())], names=["h", "item", "size", "words"])

    windows = materialize(benchmark.mapInArrow(lean(cut), f"h long, item {name}, size int, words binary"), "item-windows")
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # n values at most
    # a bit for the leading bits of each hash: 2 MB at most, however many windows there are
    lead = F.shiftrightunsigned("h", 64 - _MAP_BITS)
    held = windows.select(lead.alias("lead")).distinct().groupBy((F.col("lead") / 64).cast("long").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(lead % 64))")).alias("bits"))
    bitmap = np.zeros(1 << (_MAP_BITS - 6), np.int64)
    for r in held.collect():
        bitmap[r["at"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bitmap)
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("_text"), *keep, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_th"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table("alnum")
        seen = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rows, hashes = [], []
            for a, _, data, offsets in text_chunks(batch.column(1)):
                w = Words(data, offsets, table)
                ranges = Ranges(w.hashes())
                for size in sizes:
                    h = ranges.windows(size)
                    at = np.flatnonzero(w.doc[: len(h)] == w.doc[size - 1 :]) if len(h) else np.zeros(0, np.int64)
                    at = at[seen[(h[at] >> np.uint64(64 - _MAP_BITS)).astype(np.int64)]]
                    rows.append(w.doc[at] + a)
                    hashes.append(h[at])
            if rows:
                own = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(own)], names=["h", "_th"])

    probes = source.select("_th", "_text").distinct().mapInArrow(lean(probe), "h long, _th long").distinct()
    found = probes.join(windows, "h").groupBy(F.col("_th").alias("_k")).agg(F.collect_set(F.struct("item", "size", "h", "words")).alias("_found"))
    both = source.join(found, source["_th"] == found["_k"], "left").select("doc_id", "_text", *keep, "_found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        at = [i for i in range(2 + len(keep)) if i != 1]
        for batch in batches:
            rows = []
            for i, found in enumerate(batch.column(2 + len(keep)).to_pylist()):
                index = _Index([(x["item"], x["size"], x["h"] % (1 << 64), x["words"]) for x in found or ()])
                rows += _scan(batch.column(1).slice(i, 1), index)
            yield _report([batch.column(i) for i in at], ["doc_id", *keep], rows, to_arrow_type(kind))

    head = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return both.mapInArrow(lean(run), f"{head}, {_HITS.format(name)}")


def without_spans(text: F.Column, spans: F.Column) -> F.Column:
    """The text without the byte ranges (ordered, apart): what stands between them, joined."""
    raw = text.cast("binary")
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text)))
    parts = F.zip_with(begins, ends, lambda b, e: F.substring(raw, b + 1, e - b).cast("string"))
    return F.array_join(parts, "")
