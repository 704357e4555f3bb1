"""The operators against their plain versions, on the smallest tables and on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselwork.llm import decontamination, fair_mixing, line_edit_dedup, line_rules, queries, simhash_popcount, suffix_dedup, token_counts
from tesselwork.llm._spark import components

from . import brute

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "Ünï cödé \x00 text\x01 \x1c more"), (7, "word " * 5000), (8, "x" * 30000),
    (9, "the quick brown fox jumps over the lazy dog again and again"), (9, "the quick brown fox jumps over the lazy dog again and again"), (10, "A b\n\nA b\nA b \n\n"), (None, "no id at all"), (11, "😀" * 120),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns whose names the operators use themselves
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("id", "fp", "h", "th", "pos", "line", "source", "_text", "size", "key", "host", "label")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", source string")


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_contamination(spark, sf_dir, docs, odd, empty):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = [tuple(r)[:6] for r in queries.op3_decontamination(spark, sf_dir).collect()]
    assert key(got) == key(brute.contamination(pairs(docs), [tuple(r) for r in items.select("item_id", "text").collect()]))
    short = spark.createDataFrame([(1, "Quick BROWN"), (2, "brown"), (3, None), (4, ".. !"), (5, "jumps over the lazy dog again and again the"), (5, "jumps over the lazy dog again and again the"), (None, "one"), (6, "two"), (7, "fox jumps over the lazy dog again and")], "item_id long, text string")
    plain = {(d, w, h, n) for d, w, h, n, *_ in brute.contamination(pairs(odd), [tuple(r) for r in short.collect() if r.item_id is not None])}
    for limit in (1 << 20, 0):
        found = decontamination.contamination(odd, short, broadcast_bytes=limit).collect()
        assert len(found) == len(ODD)
        assert {(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found} == plain
        cut = decontamination.contamination(odd, short, keep=("text",), broadcast_bytes=limit).withColumn("left", decontamination.without_spans(F.col("text"), F.col("spans")))
        for r in cut.where("text is not null").collect():
            raw = bytearray(r.text.encode())
            for s in r.spans[::-1]:
                del raw[s.start : s.end]
            assert r.left == raw.decode()
    assert decontamination.contamination(empty, short).collect() == []
    assert decontamination.contamination(odd, short.limit(0)).where("n_hit > 0").count() == 0


def test_simhash(spark, docs, odd, empty):
    rows = simhash_popcount.near_duplicates(docs).collect()
    fps = {i: brute.fingerprint(t) for i, t in pairs(docs)}
    assert {r.id: r.fp % (1 << 64) for r in rows} == fps
    assert {r.id: r.component for r in rows} == brute.components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = simhash_popcount.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {(r.id, r.fp % (1 << 64)) for r in got} == {(i, brute.fingerprint(t)) for i, t in ODD}
    assert {r.component for r in got if r.fp == 0} == {1}
    assert simhash_popcount.near_duplicates(empty).collect() == []


def test_simhash_cells_are_not_broadcast(spark, monkeypatch):
    """An explode is sized as its input, so the cells of few fingerprints look small enough."""
    plans, write = [], simhash_popcount.materialize

    def written(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, tag)

    monkeypatch.setattr(simhash_popcount, "materialize", written)
    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    assert simhash_popcount.near_links(fps).count() == 0
    (plan,) = [p for tag, p in plans if tag == "simhash-cells"]
    assert "Generate explode" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_links_close_fingerprints(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base[:20]:
        for _ in range(12):
            for _ in range(random.choice((1, 2, 3))):
                b ^= 1 << random.randrange(64)
            values.add(b)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    links = simhash_popcount.near_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"))
    got = {r.node: r.component for r in components(links).collect()}
    back = {s: v for v, s in signed.items()}
    want = brute.components(sorted(signed.values()), lambda a, b: (back[a] ^ back[b]).bit_count() <= 2)
    alone = {v for v in want if sum(c == want[v] for c in want.values()) == 1}
    assert got == {v: c for v, c in want.items() if v not in alone}
    assert links.where("bit_count(a ^ b) > 2").count() == 0


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 6000 + i) for i in range(80)] + [(7, 7), (None, 3)]
    want = brute.components({x for e in edges[:-2] for x in e}, lambda a, b: (a, b) in found or (b, a) in found) if (found := set(edges)) else {}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e for e in edges[:-2] if e[0] != e[1])}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_suffix_dedup(spark, docs, odd, empty):
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert key(got) == key(brute.repeats(pairs(docs), 200))
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(odd).collect()]
    assert key(got) == key(brute.repeats(ODD, 200))
    assert suffix_dedup.suffix_dedup(empty).collect() == []


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SMALL", 4)
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 300, 3000):
        for width in (2, 50, 1 << 60):
            tokens = [r.integers(-width, width, n) for _ in range(3)]
            order = suffix_dedup.multikey_quicksort(tokens)
            assert sorted(order.tolist()) == list(range(n))
            got = list(zip(*(t[order].tolist() for t in tokens)))
            assert got == sorted(got)


@pytest.mark.parametrize("size", [7, 20, 33])
def test_suffix_dedup_random(spark, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 40 * size)  # runs lie across many ranges
    random.seed(size)
    pieces = ["".join(random.choice("abc") for _ in range(random.randrange(5, 60))) for _ in range(30)]
    rows = [(i, "".join(random.choice(pieces)[random.randrange(5) :] for _ in range(random.randrange(0, 8)))) for i in range(150)]
    rows += [(200, "z" * 90), (201, "z" * (size - 1)), (202, "é" * size), (203, None)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), size, keep=True).collect()
    assert key([tuple(r)[:5] for r in got]) == key(brute.repeats(rows, size))
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_line_rules(spark, docs, odd, empty):
    texts = dict(pairs(docs))
    for r in line_rules.line_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.line_stats(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    got = line_rules.line_rules(odd).collect()
    assert {(r.doc_id, *tuple(r)[1:6]) for r in got} == {(i, *brute.line_stats(t)) for i, t in ODD}
    assert line_rules.line_rules(empty).collect() == []


def test_common_lines(spark):
    shared = "a line that very many documents of one host share"
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(60)]
    rows = [(i, (shared + "\n") * 3 + " ".join(f"v{i}x{j}" for j in range(15)) + "\n" + "y z " * 2, "h1") for i in range(30)]
    rows += [(100 + i, shared.upper() + "  \n" + own[i], "h1" if i % 2 else None) for i in range(20)]
    rows += [(200 + i, own[40 + i], "h2") for i in range(20)]
    got = {r.doc_id: r for r in line_rules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_words=1, max_repeat_percent=100, max_docs=29, max_removed_percent=50).collect()}
    assert all(got[i].n_common_words == 34 and not got[i].kept for i in range(30))
    assert all(got[100 + i].n_common_words == (10 if i % 2 else 0) and got[100 + i].kept for i in range(20))
    assert all(got[200 + i].n_common_words == 0 and got[200 + i].kept for i in range(20))


def test_without_common_lines(spark):
    line = "Shared by  all of them"
    rows = [(i, f"{line}\n\nown {i} words\n{line.upper()} ", "h") for i in range(11)] + [(50, line, "other"), (51, None, None), (52, f"x\n{line}", "h"), (52, f"x\n{line}", "h"), (None, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("gone", F.lit("x"))
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_rules.without_common_lines(df, max_docs=12).collect()}
    assert got == {i: (2, f"\nown {i} words") for i in range(11)} | {50: (0, line), 51: (0, ""), 52: (1, "x"), None: (0, "")}
    assert all(r.n_removed == 0 and r.kept_text == (r_text or "") for r in line_rules.without_common_lines(df, max_docs=13).collect() for r_text in [dict((a, b) for a, b, _ in rows)[r.doc_id]])
    assert line_rules.without_common_lines(df.limit(0)).collect() == []


def test_fair_mixing_many_sources_of_one_document(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "'a b c' text", "concat('s', id) source").union(spark.range(300).selectExpr("cast(null as long)", "concat('null id ', id)", "'z'"))
    got = fair_mixing.fair_mix(rows).collect()
    total = sum(r.size for r in got)
    assert len(got) == 3300 and total - 3 < sum(r.taken for r in got) <= total
    assert all((r.finish is None) == (r.repeats == 0) and r.taken <= 3 * r.size for r in got)


def test_edit_distance():
    random.seed(1)
    for _ in range(6000):
        a = "".join(random.choice("ab") for _ in range(random.randrange(14)))
        b = list(a) if random.random() < 0.7 else [random.choice("ab") for _ in range(random.randrange(14))]
        for _ in range(random.randrange(5)):
            b.insert(random.randrange(len(b) + 1), random.choice("abc"))
            if random.random() < 0.5:
                b.pop(random.randrange(len(b)))
        b = "".join(b)
        for k in (0, 1, 2, 3):
            assert line_edit_dedup.within(a, b, k) == (brute.edit_distance(a, b) <= k), (a, b, k)


@pytest.mark.parametrize("few", [32, 2])
def test_line_classes(spark, monkeypatch, few):
    monkeypatch.setattr(line_edit_dedup, "FEW", few)
    monkeypatch.setattr(line_edit_dedup, "BLOCK", 10)
    monkeypatch.setattr(line_edit_dedup, "SEEN", 5)
    random.seed(few)
    base = ["".join(random.choice("abcd ") for _ in range(random.randrange(8, 30))) for _ in range(25)]
    lines = set(base)
    for b in base[:12]:
        for _ in range(8):
            x = list(b)
            for _ in range(random.randrange(1, 4)):
                op, at = random.randrange(3), random.randrange(len(x))
                if op == 0:
                    x[at] = random.choice("abcdé")
                elif op == 1:
                    x.insert(at, random.choice("abcd"))
                elif len(x) > 4:
                    x.pop(at)
            lines.add("".join(x))
    lines = sorted(lines)
    df = spark.createDataFrame([(2 * i, x) for i, x in enumerate(lines)], "id long, norm string").repartition(3)
    for limits in (((3, 2),), ((4, 1), (9, 2), (16, 3), (25, 5))):
        got = {r.id: r["class"] for r in line_edit_dedup.line_classes(df, limits).collect()}
        want = brute.components(range(len(lines)), lambda a, b: brute.same_line(lines[a], lines[b], limits))
        assert {i: got.get(2 * i, 2 * i) // 2 for i in range(len(lines))} == want


@pytest.mark.parametrize("refine", [2, 1, 0])
def test_hot_segments(spark, monkeypatch, refine):
    """Lines with common thirds: in one group by steps, in pairs far from the rest, alone."""
    for name, value in (("FEW", 4), ("BLOCK", 25), ("CROWD", 12), ("REFINE", refine)):
        monkeypatch.setattr(line_edit_dedup, name, value)
    random.seed(refine)
    head = "a passage that very many lines have in common, word for word: "
    lines = {f"{head}number {i:05d}" for i in random.sample(range(3000), 120)}
    own = ["".join(random.choice("abcdefgh ") for _ in range(60)) for _ in range(60)]
    lines |= {head + x.strip() for x in own} | {head + (x[:9] + "Z" + x[10:50] + "YZ"[: i % 3] + x[51:]).strip() for i, x in enumerate(own[:30])}
    lines |= {x.strip() + " " + head.strip() for x in own[:20]}
    lines = sorted(lines)
    df = spark.createDataFrame([(2 * i, x) for i, x in enumerate(lines)], "id long, norm string").repartition(3)
    got = {r.id: r["class"] for r in line_edit_dedup.line_classes(df).collect()}
    want = brute.components(range(len(lines)), lambda a, b: brute.same_line(lines[a], lines[b]))
    assert {i: got.get(2 * i, 2 * i) // 2 for i in range(len(lines))} == want


def test_line_dedup_against_all_pairs(spark, docs, odd):
    few = docs.where("doc_id < 60")
    for df, rows in ((few, pairs(few)), (odd, ODD)):
        got = line_edit_dedup.line_dedup(df).collect()
        assert key((r.doc_id, r.n_lines, r.n_exact, r.n_near, r.kept_text) for r in got) == key(brute.line_dedup(rows))


def test_line_dedup(spark, odd, empty):
    rows = [
        (1, "The first line of the text, long enough.\nshort\nOnly here: something else entirely, also long."),
        (2, "the first line of  the text, long enoughs\nshort\nThe first line of the text, long enough."),
        (3, "Nothing that stands in another document, truly."),
        (3, "Nothing that stands in another document, truly."),
        (4, None),
    ]
    got = line_edit_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5
    assert (by[1].n_exact, by[1].n_near, by[1].kept_text) == (0, 0, rows[0][1])
    assert (by[2].n_exact, by[2].n_near, by[2].kept_text) == (2, 1, "")
    assert (by[3].n_lines, by[3].kept_text) == (1, rows[2][1])
    assert (by[4].n_lines, by[4].kept_text) == (1, "")
    assert line_edit_dedup.line_dedup(odd).count() == len(ODD)
    assert line_edit_dedup.line_dedup(empty).collect() == []


def test_fair_mixing(spark, docs, odd, empty):
    rows = fair_mixing.fair_mix(docs).collect()
    total = sum(r.size for r in rows)
    sizes, taken, target = {}, {}, {}
    texts = dict(pairs(docs))
    for r in rows:
        assert r.size == len(brute.SPACE_WORD.findall(texts[r.doc_id]))
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    capped = set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in sizes if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sizes:
        assert target[s] == pytest.approx(3 * sizes[s] if s in capped else weight[s] * level)
        assert abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s)
    assert sum(taken.values()) <= total
    again = fair_mixing.fair_mix(docs.repartition(7)).collect()
    assert key(tuple(r) for r in rows) == key(tuple(r) for r in again)
    got = fair_mixing.fair_mix(odd.drop("source").withColumn("source", F.when(F.col("doc_id") < 6, "s"))).collect()
    assert len(got) == len(ODD)
    assert fair_mixing.fair_mix(empty).collect() == []


def test_fair_mixing_many_rows(spark):
    rows = spark.range(6000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 17 as int)) text", "case when id % 3 > 0 then 'big' when id % 2 = 0 then concat('s', id % 12) end source")
    got = fair_mixing.fair_mix(rows).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.sum("size").alias("s")).collect()
    assert all(abs(r.t - r.target) <= 17 for r in got)
    assert abs(sum(r.t for r in got) - sum(r.s for r in got)) <= 17 * len(got)


def test_token_counts(spark, docs, odd, empty):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.TOKENIZER, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    back = {v: k for k, v in ranks.items()}

    def plain(text, rule):
        text = text or ""
        tokens = [back[t] for t in encoding.encode_ordinary(text)]
        assert b"".join(tokens) == text.encode()
        section = [0]
        for c in text.encode():
            section.append(section[-1] + (c == 10))
        out, at, crossing = [0.0] * (section[-1] + 1), 0, 0
        for t in tokens:
            own = section[at : at + len(t)]
            crossing += len(set(own)) > 1
            if rule == "split":
                for s in own:
                    out[s] += 1 / len(t)
            else:
                out[own[0] if rule == "start" else max(sorted(set(own)), key=own.count)] += 1
            at += len(t)
        return len(tokens), crossing, out

    texts = [(i, t) for i, (_, t) in enumerate(ODD)] + [(50, "a\n\n\n\nb  \n  c\n"), (51, "\n\n\n")] + [(100 + i, t) for i, t in pairs(docs)[:60]]
    df = spark.createDataFrame(texts, SCHEMA)
    for rule in token_counts.RULES:
        got = token_counts.token_counts(df, rule=rule).collect()
        want = key((i, *plain(t, rule)[:2]) for i, t in texts)
        assert key((r.doc_id, r.n_tokens, r.n_crossing) for r in got) == want
        sections = {i: plain(t, rule)[2] for i, t in texts}
        assert all(np.allclose(r.section_tokens, sections[r.doc_id]) for r in got)
    two = token_counts.token_counts(df.selectExpr("doc_id", "text", "cast(null as string) title"), fields=("title", "text"), sections="fields").collect()
    assert all(r.n_sections == 2 and sum(r.section_tokens) == r.n_tokens for r in two)
    assert token_counts.token_counts(empty).collect() == []
