"""Exact removal of long repeated byte strings, by a sparse, truncated suffix array.

A byte goes if it lies in a string of `size` bytes that also starts anywhere else.  A table
of all suffixes (one per byte, each with a lead of `size` bytes) would be hundreds of times
the corpus, so suffixes are thinned without losing a match: of every `size` bytes the
leftmost start of the shorter gram with the least hash is an anchor, which depends on these
bytes alone, so equal strings have equal anchors.

1. A suffix starts at each anchor.  Its leading tokens are the anchor's gram and, as two
   more, the stretch that holds all strings whose anchor this may be.  A repeated stretch is
   removed as a whole.
2. Strings whose anchor's gram is repeated but not its stretch - the edges of repeated
   passages - are suffixes of their own, of two tokens, compared among themselves and with
   the strings of one copy of each repeated stretch whose gram also stands elsewhere.

Tokens are named by 64-bit hashes of their bytes, so that two suffixes of one token sequence
agree in 128 bits or more.  Both times splitters sampled from a bounded number of documents
cut the order of suffixes into ranges by leading tokens, ties by place; each range is sorted
by multikey quicksort and neighbours are compared; runs of equal tokens that reach a range's
first or last suffix are compared across the boundaries by their counts.  A run of any length
may lie in many ranges.  Within a batch equal suffixes are settled at once and sent on as a
single row.  Suffixes name their text by a hash, so that equal texts share what is found."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._spark import bounded_batches, lean, materialize, release
from ._text import Ranges, byte_values, mix, text_chunks

#: WITNESS only shows that the suffix exists; ASKED is wanted if it exists elsewhere; MET is the
#: first of several in its batch; SETTLED a later one, or a run of them.
WITNESS, ASKED, MET, SETTLED = range(4)
#: Documents whose suffixes are sampled for splitters, suffixes taken of each, and suffixes of
#: a range, about.
SAMPLE_DOCS, SAMPLE_SUFFIXES, RANGE_ROWS = 2000, 16, 800_000
#: Suffixes that a step of the sort takes at once.
SMALL = 2048
#: range; leading tokens a, b, c (b and c 0 if the suffix has one only; no c for edges); th: the text's hash, 0
#: for a witness; what: the state in the lowest 2 bits, then how many equal suffixes of the
#: batch it stands for in 20 bits, above them the length.
_SUFFIXES = "range int, a long, b long, c long, th long, pos int, what long"
_SHORT = "range int, a long, b long, th long, pos int, what long"


class _Anchors:
    """Anchors of the texts of a chunk: window (all starts of strings of `size` bytes within
    one text), at (each one's anchor), anchor (their distinct positions), all in the chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        self.size, self.gram = size, max(1, size * 2 // 5)
        self.ranges = Ranges(byte_values(data))
        self.ends = np.repeat(offsets[1:], np.diff(offsets))
        self.begins = np.repeat(offsets[:-1], np.diff(offsets))
        n = len(data) - size + 1
        if n <= 0:
            self.window = self.at = self.anchor = np.zeros(0, np.int64)
            return
        self.window = np.flatnonzero(np.arange(n) + size <= self.ends[:n])
        key = self.ranges.windows(self.gram)
        low = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
        width, span = size - self.gram + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            rest = width - span
            low = np.minimum(low[:-rest], low[rest:])
        self.at = (low[self.window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.anchor = self.at[np.flatnonzero(np.diff(self.at, prepend=-1))]

    def whole(self) -> np.ndarray:
        """The anchors whose stretch, what holds all strings with this anchor, lies in the text."""
        a = self.anchor
        return np.flatnonzero((a + self.gram - self.size >= self.begins[a]) & (a + self.size <= self.ends[a]))


def multikey_quicksort(tokens: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """The order that sorts rows by their tokens, one array each: three-way partitions by the
    token at hand, the equal part going on with the next token."""
    order = np.arange(len(tokens[0])) if rows is None else rows
    work = [(0, len(order), 0)]
    while work:
        lo, hi, depth = work.pop()
        if depth == len(tokens) or hi - lo < 2:
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort([t[part] for t in tokens[: depth - 1 if depth else None : -1]])]
            continue
        t = tokens[depth][part]
        pivot = np.sort(t[:: max(1, len(t) // 9)])[4 if len(t) > 9 else 0]
        less, more = t < pivot, t > pivot
        n, m = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~less & ~more], part[more]])
        work += [(lo, lo + n, depth), (lo + n, hi - m, depth + 1), (hi - m, hi, depth)]
    return order


def _runs(*tokens: np.ndarray) -> np.ndarray:
    """Whether each sorted row opens a run of equal tokens."""
    opens = np.ones(len(tokens[0]), bool)
    opens[1:] = np.logical_or.reduce([t[1:] != t[:-1] for t in tokens])
    return opens


def _settle(tokens: list[np.ndarray], row: np.ndarray, pos: np.ndarray, length: np.ndarray, asked: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Suffixes of a batch, sorted, as (a, b, c, row, pos, length, state, count): of those met
    twice here the first goes on, and those asked for besides it are settled, in runs of
    neighbouring starts if their length is size.  Suffixes whose last token is 0 are all sent
    on: only their first can be compared."""
    order = np.lexsort([~asked, *tokens[::-1]])
    a, b, c = (t[order] for t in tokens)
    opens = _runs(a, b, c) | (c == 0)
    first = np.flatnonzero(opens)
    heads = order[first]
    count = np.diff(np.append(first, len(a)))
    state = np.where(asked[heads], np.where(count > 1, MET, ASKED), WITNESS)
    met = np.sort(order[~opens])
    met = met[asked[met]]
    r, p, n = row[met], pos[met], length[met]
    if len(met):
        opens = np.ones(len(met), bool)
        opens[1:] = ~((r[1:] == r[:-1]) & (p[1:] == p[:-1] + 1) & (n[1:] == n[:-1]) & (n[1:] == size))
        begin = np.flatnonzero(opens)
        last = np.append(begin[1:], len(met)) - 1
        r, p, n = r[begin], p[begin], p[last] + n[last] - p[begin]
    none = np.zeros(len(r), np.uint64)
    return (
        *(np.concatenate([t[first], alone]) for t, alone in zip((a, b, c), (_alone(r, p), none, none))),
        np.concatenate([row[heads], r]),
        np.concatenate([pos[heads], p]),
        np.concatenate([length[heads], n]),
        np.concatenate([state, np.full(len(r), SETTLED)]),
        np.concatenate([count, np.ones(len(r), np.int64)]),
    )


def _alone(row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Hashes that spread settled suffixes over the ranges."""
    return mix(pos.astype(np.uint64) + (row.astype(np.uint64) << np.uint64(32)))


def _batch(th: np.ndarray, found: tuple[np.ndarray, ...], splitters: list[tuple], schema: str) -> pa.RecordBatch:
    a, b, c, row, pos, length, state, count = found
    seen = state != WITNESS
    what = np.where(seen, (length << 22) | (np.minimum(count, (1 << 20) - 1) << 2) | state, WITNESS)
    tokens = [x.view(np.int64) for x in ((a, b, c) if schema == _SUFFIXES else (a, b))]
    columns = [*tokens, np.where(seen, th[row], 0), np.where(seen, pos, 0)]
    order = np.lexsort(columns[::-1])
    columns, what = [x[order] for x in columns], what[order]
    # where each splitter falls among the sorted suffixes
    at = [bisect_left(range(len(order)), s, key=lambda i: tuple(int(x[i]) for x in columns)) for s in splitters]
    range_ = np.searchsorted(np.array(at, np.int64), np.arange(len(order)), "right")
    arrays = [pa.array(range_.astype(np.int32)), *(pa.array(x) for x in columns[:-1]), pa.array(columns[-1].astype(np.int32)), pa.array(what)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])


def _suffixes(texts: DataFrame, emit: Callable[[pa.RecordBatch], Iterator[tuple]], schema: str) -> DataFrame:
    """The suffixes that emit gives for batches of texts, each range a partition.  The
    splitters are quantiles of the suffixes of about SAMPLE_DOCS texts, SAMPLE_SUFFIXES of each."""
    key = [x.split()[0] for x in schema.split(", ")][1:-1]

    def dealt(splitters: list[tuple]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found in emit(batch):
                    yield _batch(batch.column(0).to_numpy(), found, splitters, schema)

        return run

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(11)
        for batch in batches:
            for found in emit(batch):
                out = _batch(batch.column(0).to_numpy(), found, [], schema)
                n = min(out.num_rows, SAMPLE_SUFFIXES * batch.num_rows)
                some = out.select(key).take(pa.array(random.permutation(out.num_rows)[:n]))
                yield some.append_column("weight", pa.array(np.full(n, out.num_rows / max(n, 1))))

    share = min(1.0, SAMPLE_DOCS / max(texts.count(), 1))
    sample = ", ".join(schema.split(", ")[1:-1]) + ", weight double"
    rows = texts.sample(False, share, 17).mapInArrow(lean(sampled), sample).collect()
    rows.sort(key=lambda r: tuple(r)[:-1])
    upto = np.cumsum([r.weight for r in rows])
    ranges = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(upto[-1] / share / RANGE_ROWS) + 1) if rows else 1
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges) if rows else []
    splitters = sorted({tuple(rows[int(i)])[:-1] for i in cuts})
    return texts.mapInArrow(lean(dealt(splitters)), schema).repartitionById(len(splitters) + 1, F.col("range")).drop("range")


#: Kinds of what a range gives: an entry of a text; one of a run that reaches the range's end,
#: by its first token and by all; and how much of such a run the range holds.
_DONE, _OPEN_FIRST, _OPEN_ALL, _EDGE_FIRST, _EDGE_ALL = range(5)
_ENTRIES = "th long, pos int, len int, n long, one boolean, open struct<kind:int,met:boolean,range:int,a:long,b:long,c:long>"


def _repeated(suffixes: DataFrame, tag: str, gram: int = 0, size: int = 0) -> DataFrame:
    """(th, found array<struct<pos, len, n, one>>) of the suffixes that occur more than once: n:
    how often, 0 for settled ones; one: whether this is the copy that speaks for the others.
    With a gram, suffixes start at anchors: there are entries for repeated grams, and for
    repeated stretches around them."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        held = pa.Table.from_batches(batches, schema)
        if not held.num_rows:
            return
        columns = {name: held[name].to_numpy() for name in held.column_names}
        del batches, held
        columns.setdefault("c", np.ones(len(columns["a"]), np.int64))
        order = multikey_quicksort([columns[x] for x in "abc"])
        a, b, c, th, pos, what = (columns[x][order] for x in ("a", "b", "c", "th", "pos", "what"))
        own, n_rows = TaskContext.get().partitionId(), len(order)
        state, count, length = what & 3, (what >> 2) & ((1 << 20) - 1), what >> 22
        count = np.maximum(count, 1)
        settled = state == SETTLED

        def entries(kind, rows, at, span, n, one) -> pa.RecordBatch:
            done = np.broadcast_to(kind == _DONE, len(rows))
            border = [np.broadcast_to(kind, len(rows)).astype(np.int32), state[rows] == MET, np.full(len(rows), own, np.int32), a[rows], b[rows], c[rows]]
            open_ = pa.StructArray.from_arrays([pa.array(x) for x in border], fields=list(kinds[-1]), mask=pa.array(done))
            arrays = [th[rows], at.astype(np.int32), np.broadcast_to(span, len(rows)).astype(np.int32), n, one]
            return pa.RecordBatch.from_arrays([*map(pa.array, arrays), open_], names=names)

        rows = np.flatnonzero(settled)
        yield entries(_DONE, rows, pos[rows], length[rows], np.zeros(len(rows), np.int64), np.zeros(len(rows), bool))
        edges = []
        for tokens, is_first in (((a,), True), ((a, b, c), False)):
            if is_first and not gram:
                continue
            opens = _runs(*tokens) if is_first else _runs(*tokens) | (c == 0)
            run = np.cumsum(opens) - 1
            heads = np.flatnonzero(opens)
            total = np.add.reduceat(np.where(settled, 0, count), heads)
            border = np.zeros(len(heads), bool)
            border[[0, -1]] = True
            border &= is_first | (c[heads] != 0)
            speaks = np.zeros(n_rows, bool)
            asked = np.flatnonzero((state == ASKED) | (state == MET))
            if not is_first:  # the first that is wanted speaks for the run
                speaks[asked[np.unique(run[asked], return_index=True)[1]]] = True
            go = ((state == MET) & (not is_first)) | (((state == ASKED) | (state == MET)) & ((total[run] > 1) | border[run]))
            rows = np.flatnonzero(go)
            at = pos[rows] if is_first or not gram else pos[rows] + gram - size
            span = gram if is_first else (2 * size - gram if gram else length[rows])
            kind = np.where(border[run[rows]], _OPEN_FIRST if is_first else _OPEN_ALL, _DONE)
            yield entries(kind, rows, at, span, total[run[rows]], speaks[rows])
            for k in np.flatnonzero(border).tolist():
                one = bool(speaks[run == k].any())
                border_ = {"kind": _EDGE_FIRST if is_first else _EDGE_ALL, "met": False, "range": own, "a": int(a[heads[k]])}
                edges.append((0, 0, 0, int(total[k]), one, border_ | ({"b": 0, "c": 0} if is_first else {"b": int(b[heads[k]]), "c": int(c[heads[k]])})))
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*edges), kinds)], names=names)

    schema = to_arrow_schema(suffixes.schema)
    names = ["th", "pos", "len", "n", "one", "open"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.struct([("kind", pa.int32()), ("met", pa.bool_()), ("range", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])]
    found = materialize(suffixes.mapInArrow(lean(ordered), _ENTRIES), tag + "-ranges")
    release(found.sparkSession)
    # across the boundaries: a few rows a range, with what the ranges hold of the runs at their ends
    ends = found.where("open is not null").select("th", "pos", "len", "n", "one", "open.*")
    first = F.col("kind").isin(_EDGE_FIRST, _OPEN_FIRST)
    ends = ends.withColumns({x: F.when(first, F.lit(0)).otherwise(F.col(x)) for x in ("b", "c")})
    edges = ends.where(F.col("kind") >= _EDGE_FIRST).groupBy((F.col("kind") - 2).alias("_k"), *[F.col(x).alias(f"_{x}") for x in "abc"])
    edges = materialize(edges.agg(F.sum("n").alias("_n"), F.min(F.when(F.col("one"), F.col("range"))).alias("_first")), tag + "-boundaries")
    same = (F.col("kind") == F.col("_k")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("c") == F.col("_c"))
    closed = ends.where(F.col("kind") < _EDGE_FIRST).join(edges, same).where((F.col("_n") > 1) | (F.col("met") & (F.col("kind") == _OPEN_ALL)))
    entry = F.struct("pos", "len", "n", "one")
    closed = closed.select("th", "pos", "len", F.col("_n").alias("n"), F.coalesce(F.col("one") & (F.col("range") == F.col("_first")), F.lit(False)).alias("one")).select("th", entry.alias("f"))
    # a set: copies of a text repeat its entries, which meet before they are sent on
    both = found.where("open is null").select("th", entry.alias("f")).union(closed)
    return materialize(both.groupBy("th").agg(F.collect_set("f").alias("found")), tag)


def _flat(batch: pa.RecordBatch, a: int, b: int, offsets: np.ndarray) -> list[np.ndarray]:
    """Positions in the chunk, lengths, counts and choices of the lists in rows a to b."""
    lists = batch.column(batch.schema.get_field_index("found")).slice(a, b - a)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    pos, length, n, one = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
    return [pos + np.repeat(offsets[:-1], counts), length.astype(np.int64), n, one]


def _keyed(docs: DataFrame, text: str, id: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).alias("doc_id"), F.xxhash64(whole).alias("th"), whole.alias("text"))


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def removed_spans(docs: DataFrame, size: int = 200, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The distinct texts that hold a repeated string: (th, text, found array<struct<pos, len,
    ...>>), the byte ranges to remove, which may overlap; th is a hash of the text.

    Null and short texts have none; repeated rows repeat each other's strings."""
    if size < 2:
        raise ValueError("size must be at least 2")
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = _keyed(docs, text, id).select("th", "text")

    gram = max(1, size * 2 // 5)

    def anchors(batch: pa.RecordBatch) -> Iterator[tuple]:
        parts = []
        for first, _, data, offsets in text_chunks(_texts(batch)):
            x = _Anchors(data, offsets, size)
            if not len(x.anchor):
                continue
            at, whole = x.anchor, x.whole()
            a, b, c = x.ranges.hash(at, at + gram), np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            b[whole] = x.ranges.hash(at[whole] + gram, at[whole] + size)
            c[whole] = x.ranges.hash(at[whole] + gram - size, at[whole]) | np.uint64(1)
            row = np.searchsorted(offsets, at, "right") - 1
            parts.append((a, b, c, row + first, at - offsets[row]))
        if parts:
            a, b, c, row, pos = (np.concatenate(p) for p in zip(*parts))
            a, b, c, row, pos, length, state, count = _settle([a, b, c], row, pos, np.full(len(a), gram), np.ones(len(a), bool), size=-1)
            # the settled ones stand for their stretch
            settled = state == SETTLED
            yield a, b, c, row, np.where(settled, pos + gram - size, pos), np.where(settled, 2 * size - gram, length), state, count

    met = _repeated(_suffixes(keyed, anchors, _SUFFIXES), "suffix-anchors", gram, size)
    # copies of a text are gathered before the join, so that many of them cost a row a task
    texts = keyed.groupBy("th").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    suspects = materialize(texts.join(met, "th"), "suffix-suspects")
    release(spark)

    def edges(batch: pa.RecordBatch) -> Iterator[tuple]:
        parts, whole, copies = [], [], batch.column(2).to_numpy()
        for a, b, data, offsets in text_chunks(_texts(batch)):
            x = _Anchors(data, offsets, size)
            pos, length, n, one = _flat(batch, a, b, offsets)
            runs = length > x.gram
            grams = np.full(len(data) + 1, -1, np.int64)  # how often a repeated gram occurs, 0 if unknown
            np.maximum.at(grams, pos[~runs], n[~runs])  # copies of a text have rows of their own
            anchor = pos[runs] + size - x.gram
            role = np.zeros(len(data) + 1, np.int8)  # 0: no repeated stretch, 1: one, 2: one that speaks for others
            np.maximum.at(role, anchor, np.where(one[runs] & (grams[anchor] != n[runs]), 2, 1).astype(np.int8))
            cover = np.zeros(len(data) + 1, np.int64)
            np.add.at(cover, pos[runs], 1)
            np.add.at(cover, pos[runs] + length[runs], -1)
            again = np.flatnonzero(copies[a:b] > 1)
            again = again[np.diff(offsets)[again] >= size]
            np.add.at(cover, offsets[again], 1)
            np.add.at(cover, offsets[again + 1], -1)
            covered = np.zeros(len(data) + 1, np.int64)
            np.cumsum(np.cumsum(cover[:-1]) > 0, out=covered[1:])
            held = role[x.at]
            go = (held == 2) | ((held == 0) & (grams[x.at] >= 0))
            w, held = x.window[go], held[go]
            asked = (held == 0) & (covered[w + size] - covered[w] < size)
            row = np.searchsorted(offsets, w, "right") - 1
            half = w + size // 2
            parts.append((x.ranges.hash(w, half), x.ranges.hash(half, w + size), row + a, w - offsets[row], np.full(len(w), size), asked))
            row = np.searchsorted(offsets, pos[runs], "right") - 1
            whole.append((row + a, pos[runs] - offsets[row], length[runs]))
            whole.append((again + a, np.zeros(len(again), np.int64), np.diff(offsets)[again]))
        if parts:
            first, second, row, pos, length, asked = (np.concatenate(c) for c in zip(*parts))
            yield _settle([first, second, np.ones(len(first), np.uint64)], row, pos, length, asked, size=size)
            row, pos, length = (np.concatenate(c) for c in zip(*whole))
            none = np.zeros(len(row), np.uint64)
            yield _alone(row, pos), none, none, row, pos, length, np.full(len(row), SETTLED), np.ones(len(row), np.int64)

    found = _repeated(_suffixes(suspects.select("th", "text", "copies", "found"), edges, _SHORT), "suffix-edges")
    return suspects.select("th", "text").join(found, "th")


def suffix_dedup(docs: DataFrame, size: int = 200, text: str = "text", id: str = "doc_id", keep: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep also the
    remaining bytes (kept, binary: a cut may fall inside a character).

    Strings are judged on the input; matches never cross texts.  A null text counts as empty;
    rows without repeats keep all their bytes.  Strings count as equal if the
    hashes of their two halves agree (128 bits), texts if their 64-bit hashes do."""
    spans = removed_spans(docs, size, text, id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, shas, rest = [], [], [], []
            for a, b, data, offsets in text_chunks(_texts(batch)):
                pos, length, *_ = _flat(batch, a, b, offsets)
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, pos, 1)
                np.add.at(cover, pos + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    g = gone[s:e]
                    left = data[s:e][~g].tobytes()
                    removed.append(int(g.sum()))
                    runs.append(int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=np.int8(0)) == 1)))
                    shas.append(hashlib.sha256(left).hexdigest())
                    rest.append(left if keep else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string()), pa.array(rest, pa.binary())], names=["th", "n_removed", "n_spans", "cut_sha256", "cut"])

    done = spans.mapInArrow(lean(cut), "th long, n_removed long, n_spans long, cut_sha256 string, cut binary")
    raw = F.col("text").cast("binary")
    base = _keyed(docs, text, id).select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"), *([raw.alias("raw")] if keep else []))
    zero = F.lit(0).cast("long")
    return base.join(done, "th", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("cut_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("cut", "raw").alias("kept")] if keep else []),
    )
