"""Line deduplication up to a few edits, by a segment-partition join.

Texts are normalised and cut into lines once; the lines are written out with two hashes.
Lines within the threshold of edits, which grows with their length, share one of threshold +
1 segments.  Segments are laid out for classes of lengths, half of them from the line's start
and half from its end, so that segment i moves by min(i, threshold - i) characters at most: of
the segments that no edit touches one has just i edits before it.  A line's own segments form
the index of its class, its substrings that far off probe the same index and, near the lower
end of a class, that of the class below; index and probe rows meet by hash.  Pairs met are
verified by edit distance in a bit-parallel band.

A segment that many lines hold does not list their pairs.  Its lines are linked to one of
them; only if they then still lie in different groups they are compared block by block, those
outside a key's largest group against the others.  Where a key has too many lines for that,
its segment is cut out and what is left of the lines meets by its own segments, and so on.
Links make classes; a class keeps its first line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, components, lean, lines_without, materialize, release
from ._text import Ranges, mix

#: (characters, edits): lines whose shorter one has at least so many characters are the same
#: within so many edits; below the first, only if they are equal.
LIMITS = ((12, 1), (24, 2), (200, 3))
#: Lengths of a class, from each limit on.
WIDTH = 16
#: Lines of a key up to which its pairs are listed; lines of a block; lines above which a key
#: is refined, and how often.
FEW, BLOCK, CROWD, REFINE = 32, 1000, 20_000, 3
#: Lines that one task remembers to have cut already (it may cut a line again).
SEEN = 200_000


#: Values of the code points below 65536, for hashing.
_POINT = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51ED27))

_UNEVEN = re.compile(r"[^\S \n]|  ")


def normalised(text: str) -> list[str]:
    """The lines of a text lowered, with white space as single spaces and none at the ends."""
    low = text.lower()
    if _UNEVEN.search(low):
        return [" ".join(line.split()) for line in low.split("\n")]
    return [line.strip(" ") for line in low.split("\n")]


def allowed(length: int, limits: tuple[tuple[int, int], ...]) -> int:
    """Edits within which a line of this length and a longer one are the same."""
    return max((edits for least, edits in limits if length >= least), default=0)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of a and b is at most k: Myers' bit vectors, cut to the band
    of 2k + 1 diagonals around the main one after equal ends are stripped."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j, n = 0, len(a)
    while j < n and a[n - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    if j:
        a, b = a[:-j], b[:-j]
    if not a:
        return len(b) <= k
    # the column vectors hold the 2k + 1 rows of b around the diagonal, bit 0 the uppermost
    rows, cols, width = len(b), len(a), 2 * k + 1
    full, top = (1 << width) - 1, 1 << (2 * k)
    where: dict[str, int] = {}
    for at, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << at
    vp, vn, start = full >> k << k, 0, -k
    below = max(0, rows - k)  # columns in which the band's lowest row lies within b
    dist, edge = (k, top >> 1) if rows >= k else (rows, 1 << (rows + k - 1))
    for col in range(cols):
        hit = where.get(a[col], 0)
        hit = (hit >> start if start >= 0 else hit << -start) & full
        d0 = ((((hit & vp) + vp) ^ vp) | hit | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if col < below:
            dist += not d0 & top
            if dist > k + cols - below:
                return False
        else:
            dist += bool(hp & edge) - bool(hn & edge)
            edge >>= 1
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
        start += 1
    return dist <= k


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins (one more at the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _classes(length: np.ndarray, limits: tuple[tuple[int, int], ...], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(least length of the class, edits) of lines of these lengths; edits 0 for no class."""
    start, edits = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for least, most in limits:
        at = length >= least
        start[at], edits[at] = least + (length[at] - least) // width * width, most
    return start, edits


def _keys(points: np.ndarray, offsets: np.ndarray, limits: tuple[tuple[int, int], ...], width: int = WIDTH) -> Iterator[tuple]:
    """(line, key, whether it is an index row, start, size, edits) of all segments and probes."""
    values = _POINT[points & 0xFFFF]
    if len(points) and points.max() > 0xFFFF:
        values = values + mix(points.astype(np.uint64) >> np.uint64(16)) * (points > 0xFFFF)
    ranges, length = Ranges(values), np.diff(offsets)
    own = _classes(length, limits, width)
    below = _classes(own[0] - 1, limits, width)
    near = np.where(length - own[0] < below[1], below[1], 0)  # the longest line below is that near
    for (start, edits), is_own in ((own, True), ((below[0], near), False)):
        for most in sorted({e for _, e in limits}):
            lines = np.flatnonzero(edits == most)
            if not len(lines):
                continue
            size, more = start[lines] // (most + 1), length[lines] - start[lines]
            for i in range(most + 1):
                begin, reach = i * size, min(i, most - i)
                if i > most - i:
                    begin = begin + more
                salt = mix((start[lines] * 64 + i).astype(np.uint64))
                for shift in range(-reach, reach + 1):
                    at = np.flatnonzero((begin + shift >= 0) & (begin + shift + size <= length[lines]))
                    s, n = begin[at] + shift, size[at]
                    go = offsets[lines[at]] + s
                    yield lines[at], mix(ranges.hash(go, go + n) ^ salt[at]), is_own and not shift, s, n, most


def lines_of(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(doc_id, th, line, id, mark, norm) of the lines that are not blank: th is a hash of the
    whole text, id (even) and mark are two hashes of the normalised line."""
    bounded_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(id).alias("doc_id"), F.xxhash64(whole).alias("th"), whole.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            row, line, norms = [], [], []
            for r, t in enumerate(batch.column(2).to_pylist()):
                for i, n in enumerate(normalised(t)):
                    if n:
                        row.append(r)
                        line.append(i)
                        norms.append(n)
            if not norms:
                continue
            hashes = np.frombuffer(b"".join([digest(n.encode()) for n in norms]), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(hashes[:, 0] & ~np.int64(1)), pa.array(hashes[:, 1].copy()), pa.array(norms, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "line", "id", "mark", "norm"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"doc_id {kind}, th long, line int, id long, mark long, norm string")


def _cut_lines(lines: DataFrame, limits: tuple) -> DataFrame:
    """lines: (id, norm) -> (key, own), own being the id, plus 1 in index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            fresh = [i for i in np.unique(ids, return_index=True)[1].tolist() if ids[i] not in seen]
            if len(seen) > SEEN:
                seen.clear()
            seen.update(ids[fresh].tolist())
            if not fresh:
                continue
            own = ids[fresh]
            parts = [(key, own[at] + base) for at, key, base, *_ in _keys(*_points(batch.column(1).take(pa.array(fresh)).to_pylist()), limits)]
            if parts:
                key, line = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(line)], names=["key", "own"])

    return lines.select("id", "norm").mapInArrow(lean(run), "key long, own long")


def _shortest(edits: int) -> int:
    """Characters that a rest must have to be cut once more."""
    return 4 * (edits + 1)


def _refined(members: DataFrame) -> DataFrame:
    """members: (key, id, edits, rest) -> (key, id, own, edits, rest): keys of what is left of
    the lines of a key, and what is left beyond them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for most in pa.compute.unique(batch.column(2)).to_pylist():
                some = batch.filter(pa.compute.equal(batch.column(2), most))
                keys, ids, texts = some.column(0).to_numpy().view(np.uint64), some.column(1).to_numpy(), some.column(3).to_pylist()
                for at, key, base, start, size, _ in _keys(*_points(texts), ((_shortest(most), most),), 8):
                    left = [texts[i][:s] + texts[i][s + n :] for i, s, n in zip(at.tolist(), start.tolist(), size.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(mix(key ^ mix(keys[at])).view(np.int64)), pa.array(ids[at]), pa.array(ids[at] + base), pa.array(np.full(len(at), most, np.int32)), pa.array(left, pa.string())], names=["key", "id", "own", "edits", "rest"])

    return members.select("key", "id", "edits", "rest").mapInArrow(lean(run), "key long, id long, own long, edits int, rest string")


def _without(members: DataFrame, limits: tuple) -> DataFrame:
    """members: (key, id, norm) -> (key, id, edits, rest): the lines without the segment of
    their key, and the edits of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, ids, texts = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for at, key, _, start, size, most in _keys(*_points(texts), limits):
                good = np.flatnonzero(key == wanted[at])
                if len(good):
                    left = [texts[i][:s] + texts[i][s + n :] for i, s, n in zip(at[good].tolist(), start[good].tolist(), size[good].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(wanted[at[good]].view(np.int64)), pa.array(ids[at[good]]), pa.array(np.full(len(good), most, np.int32)), pa.array(left, pa.string())], names=["key", "id", "edits", "rest"])

    return members.select("key", "id", "norm").mapInArrow(lean(run), "key long, id long, edits int, rest string").distinct()


def _met(rows: DataFrame) -> DataFrame:
    """rows: (key, own) -> (key, a, b): the pairs of lines that share a key, one at least by its
    index row; for a key of more than FEW lines a row (key, line, null) for each."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # the last key's rows so far, at most FEW lines
        hot: int | None = None  # the last key, if it has more

        def out(key: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            other = pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), other], names=["key", "a", "b"])

        def settle(key: np.ndarray, line: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs of whole groups of few lines each."""
            opens = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(opens, len(key)))
            for size in np.unique(sizes[sizes > 1]).tolist():
                at = opens[sizes == size]
                i, j = np.triu_indices(size, 1)
                left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                good = base[left] | base[right]
                left, right = left[good], right[good]
                if len(left):
                    yield out(key[left], np.minimum(line[left], line[right]), np.maximum(line[left], line[right]))

        for batch in batches:
            key, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            line, base = own & ~np.int64(1), (own & 1).astype(bool)
            if held is not None:
                key, line, base = (np.concatenate(x) for x in zip(held, (key, line, base)))
            # one row a line and key, the index row if there is one
            order = np.lexsort((~base, line, key))
            key, line, base = key[order], line[order], base[order]
            first = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])) if len(key) else np.zeros(0, bool)
            key, line, base = key[first], line[first], base[first]
            opens = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(opens, len(key)))
            group = np.repeat(np.arange(len(opens)), sizes)
            many = (sizes > FEW) | (key[opens] == hot if hot is not None else False)
            is_many = many[group]
            if is_many.any():
                yield out(key[is_many], line[is_many], None)
            last = group == len(opens) - 1
            open_ = last & ~is_many
            done = ~is_many & ~open_
            if done.any():
                yield from settle(key[done], line[done], base[done])
            hot = int(key[-1]) if len(key) and is_many[-1] else None
            held = (key[open_], line[open_], base[open_]) if open_.any() else None
        if held is not None:
            yield from settle(*held)

    return rows.select("key", "own").repartition("key").sortWithinPartitions("key").mapInArrow(lean(pairs), "key long, a long, b long")


def _stars(members: DataFrame) -> DataFrame:
    """members: (key, id) -> (a, b): each line of a key with one of them."""
    hubs = members.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("hub"))
    return members.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def _close(a: list[str], b: list[str], limits: tuple) -> list[bool]:
    return [within(x, y, allowed(min(len(x), len(y)), limits)) for x, y in zip(a, b)]


def _verified(pairs: DataFrame, texts: DataFrame, limits: tuple) -> DataFrame:
    """Of the pairs (a, b) those within their threshold."""
    left = texts.select(F.col("id").alias("a"), F.col("norm").alias("na"))
    right = texts.select(F.col("id").alias("b"), F.col("norm").alias("nb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _close(batch.column(2).to_pylist(), batch.column(3).to_pylist(), limits)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb").mapInArrow(lean(verify), "a long, b long")


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with their component, of the keys whose members lie in more than one."""
    found = components(links, "line-cc").select(F.col("node").alias("id"), "component")
    named = members.distinct().join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialize(named, "line-members")
    split = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return materialize(named.join(split, "key", "left_semi"), "line-apart")


def _blocks(members: DataFrame, texts: DataFrame, limits: tuple) -> DataFrame:
    """Links among members (key, id, component) of one key and different components: those
    outside a key's largest component against all others of the key, a task for each pair of
    blocks, which compares what it has not joined yet."""
    members = members.select("key", "id", "component").distinct()
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), F.max("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("key", "most", blocks(F.col("all") - F.col("n")).alias("xs"), blocks(F.col("all")).alias("ys"))
    dealt = members.join(sizes, "key").withColumn("own", F.xxhash64("id", F.lit(1)))
    x, y = F.pmod("own", "xs").cast("int"), F.pmod("own", "ys").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = dealt.where("component <> most").select("key", "id", "component", F.lit(True).alias("outer"), x.alias("x"), every("ys").alias("y"))
    inner = dealt.select("key", "id", "component", F.lit(False).alias("outer"), every("xs").alias("x"), y.alias("y"))
    rows = outer.union(inner).join(texts.select("id", "norm"), "id").select("key", "id", "component", "outer", "x", "y", "norm")

    most = max(e for _, e in limits)

    def join(group: pa.Table) -> pa.Table:
        ids, named, outer, texts = (group[c].to_pylist() for c in ("id", "component", "outer", "norm"))
        root = {c: c for c in named}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        # lines within k edits differ by 2k at most in how often they have each of 64 kinds of characters
        marks = np.array([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64) for t in texts], np.int16)
        whose, is_outer = np.array(named), np.array(outer)
        inner, rows = np.flatnonzero(~is_outer), np.flatnonzero(is_outer)
        a, b = [], []
        for some in (rows[k : k + 64] for k in range(0, len(rows), 64)):
            far = np.abs(marks[inner][None] - marks[some][:, None]).sum(axis=2) > 2 * most
            for i, j in zip(*np.nonzero(~far & (whose[some][:, None] != whose[inner]))):
                i, j = int(some[i]), int(inner[j])
                if find(named[i]) != find(named[j]) and _close([texts[i]], [texts[j]], limits)[0]:
                    root[find(named[i])] = find(named[j])
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "x", "y").applyInArrow(join, "a long, b long")


def line_classes(lines: DataFrame, limits: tuple = LIMITS, firsts: DataFrame | None = None) -> DataFrame:
    """(id, class) of the distinct lines that have others within the limits of edits: class is
    the smallest id reachable.

    lines: (id, norm) and more columns; ids are even; lines with one id are one line.  firsts:
    (id, at struct<doc_id, th, line, ...>), where each stands first, if lines have places."""
    if any(least <= edits for least, edits in limits):
        raise ValueError("lines need more characters than edits")
    met = materialize(_met(_cut_lines(lines, limits)), "line-keys")
    release(lines.sparkSession)
    many = met.where("b is null").select("key", F.col("a").alias("id"))
    pairs = met.where("b is not null").select("a", "b").union(_stars(many)).distinct()
    pairs = materialize(pairs, "line-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # the text of a line comes from its first place, however many others it has
    if firsts is None:
        texts = lines.join(wanted, "id", "left_semi").select("id", "norm").dropDuplicates(["id"])
    else:
        p = firsts.join(wanted, "id").select("id", F.col("at.doc_id").alias("_d"), F.col("at.th").alias("_t"), F.col("at.line").alias("_l"))
        same = (F.col("th") == F.col("_t")) & (F.col("line") == F.col("_l")) & F.col("doc_id").eqNullSafe(F.col("_d"))
        texts = lines.join(p, "id").where(same).select("id", "norm").dropDuplicates(["id"])
    texts = materialize(texts, "line-texts")
    release(lines.sparkSession)
    links = materialize(_verified(pairs, texts, limits), "line-links")

    apart, rests = _apart(many, links), None
    for level in range(REFINE + 1):
        if apart.isEmpty():
            break
        big = apart.groupBy("key").agg(F.countDistinct("id").alias("n")).where(F.col("n") > CROWD).select("key")
        crowded = materialize(apart.join(big, "key", "left_semi"), "line-crowds")
        if level == REFINE or crowded.isEmpty():
            links = links.union(_blocks(apart, texts, limits))
            break
        more = _blocks(apart.join(big, "key", "left_anti"), texts, limits)
        if rests is None:
            rests = materialize(_without(crowded.select("key", "id").join(texts, "id"), limits), "line-rests")
        else:
            rests = materialize(rests.join(crowded.select("key", "id").distinct(), ["key", "id"], "left_semi").distinct(), "line-rests")
        # rests too short to be cut stay with their key, and with them those they may be near to
        least = 4 * (F.col("edits") + 1)
        short = rests.where(F.length("rest") < least + F.col("edits")).join(crowded, ["key", "id"]).select("key", "id", "component")
        tiny = short.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        more = more.union(_blocks(short.join(tiny, "key", "left_semi"), texts, limits))
        fine = materialize(_refined(rests.where(F.length("rest") >= least)), "line-refined")
        met = materialize(_met(fine), "line-keys")
        many = met.where("b is null").select("key", F.col("a").alias("id"))
        pairs = met.where("b is not null").select("a", "b").union(_stars(many)).distinct()
        links = materialize(links.union(more).union(_verified(pairs, texts, limits)).distinct(), "line-links")
        apart, rests = _apart(many, links), fine.select("key", "id", "edits", "rest")
    return components(links, "line-cc").select(F.col("node").alias("id"), F.col("component").alias("class"))


def dropped_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", limits: tuple = LIMITS) -> DataFrame:
    """(doc_id, th, drop array<struct<line,exact>>): the lines that repeat an earlier one, in
    documents that have any."""
    lines = materialize(lines_of(docs, text, id), "lines")
    ids = lines.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "line", "mark")).alias("at"))
    ids = materialize(ids, "line-firsts")
    classes = line_classes(lines, limits, ids)
    ids = materialize(ids.join(classes, "id", "left").where("n > 1 or class is not null").withColumn("class", F.coalesce("class", "id")), "line-ids")
    firsts = ids.groupBy("class").agg(F.min("at").alias("keep"))
    ids = ids.join(firsts, "class").select("id", F.col("at").alias("own"), "keep")
    place = F.struct("doc_id", "th", "line", "mark")
    # a line goes only if both hashes are those of the line that speaks for it
    hits = lines.select("id", place.alias("at")).join(ids, "id").where((F.col("at.mark") == F.col("own.mark")) & ~F.col("at").eqNullSafe(F.col("keep")))
    line = F.struct(F.col("at.line").alias("line"), F.col("own").eqNullSafe(F.col("keep")).alias("exact"))
    return hits.groupBy("at.doc_id", "at.th").agg(F.collect_set(line).alias("drop"))


def line_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", limits: tuple = LIMITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_exact (lines dropped that repeat the class's first
    line), n_near (dropped others), kept_text, and the columns named in keep.

    Lines are compared lowered, with white space runs as one space; classes are the connected
    groups of lines within the edits that limits allow the shorter one (lines shorter than the
    first limit have only exact repeats); blank lines are kept.  The first
    line of a class, by id (nulls first), text hash and place, stays.  Rows that repeat id and
    text are one document and keep the same lines.  A null text counts as one empty line.
    Lines are named by 127 bits of hashes."""
    drops = dropped_lines(docs, text, id, limits)
    d = drops.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.array_sort("drop").alias("_drop"))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(id).alias("doc_id"), whole.alias("_text"), F.xxhash64(whole).alias("_th"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)])
    both = own.join(d, (F.col("_th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    n_exact = F.coalesce(F.size(F.filter("_drop", lambda x: x["exact"])), F.lit(0))
    n_drop = F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop"))
    both = both.withColumn("_lines", F.when(F.col("_drop").isNotNull(), F.split("_text", "\n"))).withColumn("_gone", F.col("_drop.line"))
    n_lines = F.octet_length("_text") - F.octet_length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1
    n_exact = F.when(F.col("_drop").isNull(), 0).otherwise(n_exact)
    return both.select(
        "doc_id",
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        n_lines.cast("long").alias("n_lines"),
        n_exact.cast("long").alias("n_exact"),
        (n_drop - n_exact).cast("long").alias("n_near"),
        F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(lines_without("_lines", "_gone")).alias("kept_text"),
    )
