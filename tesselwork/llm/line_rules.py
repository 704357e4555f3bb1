"""Quality rules with cross-document line frequency.

One pass over the texts counts words, symbols, repeated lines and repeated word windows and
hashes each document's distinct normalised lines.  The hashes are counted per host with a
map-side combine; lines in too many of a host's documents are removed (without_common_lines
gives the texts), and a document that loses most of its words this way is rejected, as is one
that fails the base rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, lean, lines_without, materialize
from ._text import Ranges, Words, byte_values, mix, per_row, text_chunks, word_table

SYMBOLS = b"#*$%&|<>"

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _within(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes made distinct between rows."""
    return mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether an equal key stands before it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def _chunk(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The five counts of each row; (row, hash, words) of each row's distinct normalised lines;
    (row, hash, number) of all its lines with words."""
    w = Words(data, offsets, word_table("lower"))
    rows = len(offsets) - 1
    symbols = np.zeros(256, np.int64)
    symbols[list(SYMBOLS)] = 1
    chars = w.inside & ((data & 0xC0) != 0x80)
    hashes = w.hashes()

    ranges = Ranges(hashes)
    h3 = ranges.windows(3)
    repeated = np.zeros(len(hashes) + 1, np.int64)
    if len(h3):
        # windows are compared as written, not lowered: their words' exact bytes
        exact = Ranges(Ranges(byte_values(data)).hash(w.start, w.end)).windows(3)
        at = np.flatnonzero(w.doc[: len(exact)] == w.doc[2:])
        twice = at[_repeats(_within(exact[at], w.doc[at]))[0]]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + 3, -1)
    in_window = (np.cumsum(repeated)[:-1] > 0).astype(np.int64)

    breaks = np.flatnonzero(data == 10)
    # a line starts at each row's start and after each of its breaks, even at the row's very end
    begin = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, offsets[row + 1], np.append(begin[1:], 0) - 1)
    lo, hi = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    wordy = hi > lo
    number = np.arange(len(row)) - np.searchsorted(row, row)
    row, begin, end, lo, hi, number = (x[wordy] for x in (row, begin, end, lo, hi, number))
    raw = Ranges(byte_values(data)).hash(begin, end)
    later = _repeats(_within(raw, row))[1].astype(np.int64)

    norm = ranges.hash(lo, hi)
    key = _within(norm, row)
    order = np.argsort(key, kind="stable")
    opens = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else order
    words = np.add.reduceat((hi - lo)[order], opens) if len(order) else order
    heads = order[opens]
    back = np.argsort(row[heads], kind="stable")
    lines = row[heads][back], norm[heads][back], words[back]
    every = row, norm, number
    by_row = np.searchsorted(row, np.arange(rows + 1))
    return [w.count, per_row(chars, offsets), per_row(symbols[data], offsets), per_row(later, by_row), per_row(in_window, w.first)], lines, every


def _measured(docs: DataFrame, text: str, id: str, host: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(text).cast("string").alias("_text"), F.col(id).alias("doc_id"), F.col(host).cast("string").alias("host"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, counts, hashes, words = [], [], [], []
            for a, b, data, offsets in text_chunks(batch.column(0)):
                five, (row, h, n), _ = _chunk(data, offsets)
                stats.append(five)
                counts.append(np.bincount(row, minlength=b - a))
                hashes.append(h)
                words.append(n)
            if not stats:
                continue
            at = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(np.concatenate(counts), out=at[1:])
            line = pa.StructArray.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(words).astype(np.int32))], names=["h", "n"])
            five = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*stats)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *five, pa.ListArray.from_arrays(pa.array(at), line)], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    return source.mapInArrow(lean(run), f"doc_id {kind}, host string, {_STATS}, lines array<struct<h:long,n:int>>")


def common_lines(measured: DataFrame, max_docs: int) -> DataFrame:
    """(host, h, n_docs) of the lines found in more than max_docs documents of a host."""
    lines = measured.select("host", F.explode("lines.h").alias("h"))
    return lines.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def line_rules(docs: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_docs: int = 10, max_removed_percent: int = 70) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_common_words (words in lines removed as too frequent on the host), base_failed, kept.

    A line is removed if more than max_docs documents of the host hold it.  Every row, repeated
    ones too, counts as a document of its host; rows without a host share the null host.  A
    null or empty text has no words, and so fails the base rules; a text of any length is
    measured whole.  kept is false if the base
    rules fail or more than max_removed_percent of the words stand in common lines."""
    measured = materialize(_measured(docs, text, id, host).withColumn("_row", F.monotonically_increasing_id()), "line-rules")
    common = common_lines(measured, max_docs).select(F.col("host").alias("_h"), F.col("h").alias("_line"))
    lines = measured.select("_row", "host", F.explode("lines").alias("l")).select("_row", "host", "l.h", "l.n")
    removed = lines.join(common, (lines.h == common["_line"]) & lines.host.eqNullSafe(common["_h"])).groupBy("_row").agg(F.sum("n").alias("n_common_words"))
    full = measured.join(removed, "_row", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = 100 * F.col("n_common_words") > max_removed_percent * F.col("n_words")
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def without_common_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", max_docs: int = 10) -> DataFrame:
    """Per row of docs: doc_id, host, n_removed (lines that more than max_docs documents of the
    host hold) and kept_text, the text without them.  Lines without words stay; a null text
    counts as empty; rows that repeat id, host and text keep the same lines."""
    bounded_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(whole.alias("_text"), F.col(id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(whole).alias("_th"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(0)):
                row, h, number = _chunk(data, offsets)[2]
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (1, 2, 3)), pa.array(h.view(np.int64)), pa.array(number.astype(np.int32))], names=["doc_id", "host", "_th", "h", "line"])

    lines = materialize(rows.mapInArrow(lean(run), f"doc_id {kind}, host string, _th long, h long, line int"), "common-lines")
    own = lines.groupBy("doc_id", "host", "_th", "h").agg(F.array_sort(F.collect_set("line")).alias("at"))
    # a row that is there several times counts as often
    times = rows.groupBy("doc_id", "host", "_th").agg(F.count("*").alias("n"))
    t = times.select(F.col("doc_id").alias("t_doc_id"), F.col("host").alias("t_host"), F.col("_th").alias("t_th"), "n")
    counted = own.join(t, F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & F.col("host").eqNullSafe(F.col("t_host")) & (F.col("_th") == F.col("t_th")))
    common = counted.groupBy("host", "h").agg(F.sum("n").alias("n")).where(F.col("n") > max_docs).select(F.col("host").alias("c_host"), F.col("h").alias("c_h"))
    gone = own.join(common, (F.col("h") == F.col("c_h")) & F.col("host").eqNullSafe(F.col("c_host"))).groupBy("doc_id", "host", "_th").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("gone"))
    g = gone.select(F.col("doc_id").alias("g_doc_id"), F.col("host").alias("g_host"), F.col("_th").alias("g_th"), "gone")
    both = rows.join(g, F.col("doc_id").eqNullSafe(F.col("g_doc_id")) & F.col("host").eqNullSafe(F.col("g_host")) & (F.col("_th") == F.col("g_th")), "left")
    both = both.withColumn("_lines", F.when(F.col("gone").isNotNull(), F.split("_text", "\n")))
    return both.select("doc_id", "host", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), F.col("_text")).otherwise(lines_without("_lines", "gone")).alias("kept_text"))
