"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise part in linear
time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2 over the factors.  It is fitted on the
driver on a bounded sample of labelled rows; the weights have a fixed size and travel to the
executors, which score every whole text in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, lean
from ._text import Ranges, Words, byte_values, per_row, text_chunks, word_table
from .line_rules import _repeats, _within

#: Hash buckets of words; structure features follow after them.
BUCKETS = 1 << 14
FACTORS = 8
#: Labelled rows the model is fitted on, at most: those with the least hash of their id.
SAMPLE_ROWS = 4000

#: Upper ends of the bins of each structure feature (fixed values).
_BINS = {
    "log_words": [1, 2, 3, 4, 5, 6, 7, 8, 9],
    "word_length": [2, 3, 4, 5, 6, 8, 10, 15],
    "symbols": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "upper": [0.01, 0.03, 0.06, 0.1, 0.2, 0.5, 0.8],
    "digits": [0.001, 0.01, 0.03, 0.1, 0.3],
    "marks": [0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3],
    "repeated_lines": [0.001, 0.05, 0.1, 0.2, 0.4, 0.6],
    "repeated_words": [0.001, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6],
    "distinct_words": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "line_words": [3, 6, 12, 25, 50, 100, 200],
    "log_chars": [3, 4, 5, 6, 7, 8, 9, 10, 11],
}
_STRUCTURE = sum(len(b) + 1 for b in _BINS.values())
#: Bins of a metadata column: powers of two of the value, the last two for below zero and null.
_META = 42


def _structure(data: np.ndarray, offsets: np.ndarray, w: Words, distinct: np.ndarray) -> np.ndarray:
    """Indices of the bin of each structure feature, rows x features."""
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(w.count, 1)
    share = lambda mask: per_row(mask.astype(np.int64), offsets) / size
    upper, digit, space = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), (data == 32) | ((data >= 9) & (data <= 13))
    ascii_mark = (data > 32) & (data < 127) & ~digit & ~upper & ~((data >= 97) & (data <= 122))
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>{}[]\\^~=+_@", np.uint8))
    breaks = np.flatnonzero(data == 10)
    own = np.searchsorted(offsets, breaks, "right") - 1
    lines = np.bincount(own, minlength=rows) + 1
    begin = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(rows), own])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    end = np.where(np.append(row[1:] != row[:-1], True), offsets[row + 1], np.append(begin[1:], 0) - 1)
    raw = Ranges(byte_values(data)).hash(begin, end)
    later = _repeats(_within(raw, row))[1] & (end > begin)
    hashes = w.hashes()
    h3 = Ranges(hashes).windows(3)
    again = np.zeros(len(hashes), np.int64)
    if len(h3):
        at = np.flatnonzero(w.doc[: len(h3)] == w.doc[2:])
        again[at] = _repeats(_within(h3[at], w.doc[at]))[1]
    values = {
        "log_words": np.log1p(w.count),
        "word_length": per_row(w.inside.astype(np.int64), offsets) / words,
        "symbols": share(symbol),
        "upper": share(upper),
        "digits": share(digit),
        "marks": share(ascii_mark),
        "repeated_lines": np.bincount(row[later], minlength=rows) / lines,
        "repeated_words": per_row(again, w.first) / words,
        "distinct_words": distinct / words,
        "line_words": w.count / lines,
        "log_chars": np.log1p(per_row(((data & 0xC0) != 0x80).astype(np.int64), offsets)),
    }
    out, base = np.empty((rows, len(_BINS)), np.int64), BUCKETS
    for j, (name, bins) in enumerate(_BINS.items()):
        out[:, j] = base + np.searchsorted(bins, values[name])
        base += len(bins) + 1
    return out


def _metadata(values: np.ndarray) -> np.ndarray:
    """Indices of the bins of metadata values (rows x columns, null as NaN)."""
    bins = np.minimum(np.log2(1 + np.maximum(np.nan_to_num(values), 0)), _META - 3).astype(np.int64)
    bins = np.where(np.isnan(values), _META - 1, np.where(values < 0, _META - 2, bins))
    return BUCKETS + _STRUCTURE + bins + _META * np.arange(values.shape[1])


def features(data: np.ndarray, offsets: np.ndarray, metadata: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a chunk of texts: first (one more than rows), index, value.  Each row has
    its structure and metadata bins, and word buckets with damped counts of unit length."""
    w = Words(data, offsets, word_table("alnum"))
    rows = len(offsets) - 1
    key = w.doc * BUCKETS + (w.hashes() & np.uint64(BUCKETS - 1)).astype(np.int64)
    cell, count = np.unique(key, return_counts=True)
    row, bucket = cell // BUCKETS, cell % BUCKETS
    value = 1 + np.log(count)
    distinct = np.bincount(row, minlength=rows)
    norm = np.sqrt(np.bincount(row, value * value, minlength=rows))
    value = value / np.maximum(norm, 1e-9)[row]
    bins = _structure(data, offsets, w, distinct)
    if metadata is not None and metadata.shape[1]:
        bins = np.concatenate([bins, _metadata(metadata)], axis=1)
    index = np.concatenate([bins.ravel(), bucket])
    value = np.concatenate([np.full(bins.size, 0.5), value])
    owner = np.concatenate([np.repeat(np.arange(rows), bins.shape[1]), row])
    order = np.argsort(owner, kind="stable")
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(distinct + bins.shape[1], out=first[1:])
    return first, index[order].astype(np.int32), value[order].astype(np.float32)


class FactorisationMachine:
    """Weights w0, w (features), v (features x factors); fitted with AdaGrad on log loss."""

    def __init__(self, size: int = BUCKETS + _STRUCTURE, factors: int = FACTORS, seed: int = 7, metadata: tuple[str, ...] = ()):
        self.metadata = metadata
        size += _META * len(metadata)
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = (np.random.default_rng(seed).standard_normal((size, factors)) * 0.05).astype(np.float32)

    def raw(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and each row's sums of v_i x_i."""
        each = self.v[index] * value[:, None]
        total = np.add.reduceat(each, first[:-1], axis=0)
        squares = np.add.reduceat((each * each).sum(axis=1), first[:-1])
        linear = np.add.reduceat(self.w[index] * value, first[:-1])
        return self.w0 + linear + 0.5 * ((total * total).sum(axis=1) - squares), total

    def scores(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(first, index, value)[0].astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """rows: (index, value) of each; labels 0 or 1.  Without rows every score stays 0.5."""
        if not len(rows):
            return self
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        self.w0 = float(np.log(share / (1 - share)))
        random, g0 = np.random.default_rng(seed), 1.0
        gw, gv = np.full_like(self.w, 0.1), np.full_like(self.v, 0.1)
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                first = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in some])])
                index = np.concatenate([rows[i][0] for i in some])
                value = np.concatenate([rows[i][1] for i in some])
                raw, total = self.raw(first, index, value)
                error = (1 / (1 + np.exp(-raw)) - labels[some]) / len(some)
                own = np.repeat(np.arange(len(some)), np.diff(first))
                seen, back = np.unique(index, return_inverse=True)
                g = error[own] * value
                dw = np.bincount(back, g, minlength=len(seen)) + decay * self.w[seen]
                slope = g[:, None] * (total[own] - self.v[index] * value[:, None])
                dv = np.stack([np.bincount(back, slope[:, k], minlength=len(seen)) for k in range(slope.shape[1])], axis=1) + decay * self.v[seen]
                gw[seen] += 100 * dw * dw
                gv[seen] += 100 * dv * dv
                self.w[seen] -= rate * 10 * dw / np.sqrt(gw[seen])
                self.v[seen] -= rate * 2 * dv / np.sqrt(gv[seen])
                d0 = float(error.sum())
                g0 += 100 * d0 * d0
                self.w0 -= rate * 10 * d0 / g0**0.5
        return self


def _columns(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """n columns of a batch as rows x columns, null as NaN."""
    found = [batch.column(first + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)]
    return np.stack(found, axis=1) if n else np.zeros((batch.num_rows, 0))


def _featured(texts: DataFrame, n: int) -> DataFrame:
    """texts: (doc_id, label, text, n metadata columns) -> doc_id, label, and the sparse
    features as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value, meta = [], [], _columns(batch, 3, n)
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                first, i, v = features(data, offsets, meta[lo:hi])
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    index.append(i[a:b].tobytes())
                    value.append(v[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "label", "idx", "val"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lean(run), f"doc_id {kind}, label int, idx binary, val binary")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS, metadata: tuple[str, ...] = ()) -> FactorisationMachine:
    """Fit on at most sample_rows labelled texts, chosen by a hash of their id, with the numeric
    columns of docs named in metadata.  Null ids,
    labels other than 0 and 1 and ids without a row are left out; ids labelled both ways are
    left out too; of several texts of one id the one with the least hash counts.  Without
    labelled texts every score is 0.5."""
    bounded_batches(docs.sparkSession)
    one = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("_id")).agg(F.min(label).cast("int").alias("label"), F.max(label).alias("_hi")).where("label = _hi and _id is not null")
    # the ids are sampled before any text is read
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_id", "label")
    meta = [F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata)]
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"), *meta).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # one text an id, so that what is collected stays within sample_rows
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text", *[f"_m{i}" for i in range(len(metadata))])).alias("t"))
    rows = _featured(texts.select("doc_id", "label", "t.text", *[f"t._m{i}" for i in range(len(metadata))]), len(metadata)).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.idx), bytes(r.val)))
    sparse = [(np.frombuffer(bytes(r.idx), np.int32), np.frombuffer(bytes(r.val), np.float32)) for r in rows]
    return FactorisationMachine(metadata=metadata).fit(sparse, np.array([r.label for r in rows], np.float32))


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns named in keep and the score, 0 to 1, of every row's whole text, however long
    (a null text counts as empty; an empty one is scored by its structure).  Equal texts have
    equal scores, repeated rows stay."""
    bounded_batches(docs.sparkSession)
    n = len(model.metadata)
    source = docs.select(F.col(text).cast("string").alias("_text"), *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(model.metadata)], *[F.col(c) for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorisationMachine(1, 1)
        m.w0, m.w, m.v = shared.value
        for batch in batches:
            meta = _columns(batch, 1, n)
            found = [m.scores(*features(data, offsets, meta[a:b])) for a, b, data, offsets in text_chunks(batch.column(0))]
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns[1 + n :], pa.array(np.concatenate(found))], names=[*keep, name])

    head = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(lean(run), f"{head}, {name} double")
