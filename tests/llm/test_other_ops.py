"""Operators with results of their own kind: links, labels, main texts, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesselwork.llm import fm_classifier, html_blocks, queries, quotation_linking
from tesselwork.llm._spark import materialize

from . import brute

THREAD = [
    (1, 0, "Who has the key?\n\nIt was on the   table."),
    (1, 1, "> Who has the key?\n\nI do."),
    (1, 2, "Anna wrote:\n> it was ON the table.\n> nobody said this\n\nNot any more."),
    (1, 3, ">> Who has the key?\n> I do.\nGood."),
    (1, 4, "Nothing quoted here."),
    (2, 0, "> I do.\nSaid elsewhere."),
    (2, 1, None),
    (2, 2, ""),
    (None, 0, "> \n>\n> Who has the key?"),
    (None, None, "no place"),
    (3, 5, "ok"),
    (3, 5, "ok"),
    (3, 6, "> ok\nfine"),
]


def test_quotation_linking(spark):
    df = spark.createDataFrame(THREAD, "conv_id long, turn long, text string").withColumn("role", F.lit("user")).withColumn("hash", F.lit("x")).repartition(3)
    got = quotation_linking.reply_order(df).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(THREAD)
    assert by[1, 0].text == "Who has the key?\n\nIt was on the   table." and by[1, 0].n_quotes == 0 and by[1, 0].reply_to is None
    assert (by[1, 1].text, by[1, 1].reply_to, by[1, 1].n_quotes, by[1, 1].n_linked) == ("I do.", 0, 1, 1)
    assert (by[1, 2].text, by[1, 2].reply_to, by[1, 2].n_linked) == ("Not any more.", 0, 1)  # half of the passage
    assert (by[1, 3].text, by[1, 3].reply_to, by[1, 3].n_linked, by[1, 3].max_level) == ("Good.", 1, 2, 2)
    assert by[1, 4].reply_to is None
    assert (by[2, 0].reply_to, by[2, 0].n_linked, tuple(by[2, 0].origin)) == (None, 1, (1, 1))
    assert by[2, 1].text == "" and by[2, 2].text == ""
    assert tuple(by[None, 0].origin) == (1, 0) and by[None, 0].text == ""
    assert by[3, 6].reply_to == 5 and by[3, 6].text == "fine"
    for conv in (1, 2, 3):
        rows = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        seen = set()
        for r in rows:
            assert r.reply_to is None or r.reply_to in seen
            seen.add(r.turn)
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)] == [0, 1, 3, 2, 4]
    assert quotation_linking.reply_order(df.limit(0)).collect() == []


def test_quotations_in_part_unknown_and_nested(spark):
    rows = [
        (1, 0, "One line here.\nA second line there.\nAnd a third."),
        (1, 1, "> A second line there.\n> And a third.\n\nTo these two."),
        (1, 2, "Bob wrote:\n> never said by anybody\nStill mine."),
        (1, 3, ">> A second line there.\n>> And a third.\n> To these two.\nDeep."),
        (1, 4, "> Deep.\nDeeper."),
        (1, 5, "> One line here.\nLate reply to the first."),
        (1, 6, "> Still mine.\n> said nowhere, and much longer than the other line\nLess than half."),
        (2, 0, "thanks"),
        (2, 1, "> thanks\nfor what"),
        (0, 0, "> thanks\nsaid in another conversation only"),
    ]
    clash = ("reply_to", "position", "n_quotes", "origin", "clean", "hash", "_row", "depth", "mark", "kind", "text_")
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumns({c: F.lit("x") for c in clash})
    got = quotation_linking.reply_order(df)
    assert {"message_reply_to", "message_position", "hash", "_row", "clean", "message_depth"} <= set(got.columns)
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert {t: by[1, t].reply_to for t in range(7)} == {0: None, 1: 0, 2: None, 3: 1, 4: 3, 5: 0, 6: None}
    assert {t: by[1, t].depth for t in range(7)} == {0: 0, 1: 1, 2: 0, 3: 2, 4: 3, 5: 1, 6: 0}
    assert [t for t in sorted(range(7), key=lambda t: by[1, t].position)] == [0, 1, 3, 4, 5, 2, 6]
    assert by[1, 2].text == "Bob wrote:\n> never said by anybody\nStill mine." and by[1, 3].text == "Deep."
    assert by[1, 6].text.startswith("> Still mine.") and (by[1, 6].n_quotes, by[1, 6].n_linked) == (1, 0)
    assert by[2, 1].reply_to == 0 and tuple(by[0, 0].origin) == (2, 0)


def test_planted_quotations_are_found(spark):
    r = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{r.integers(3000)}" for _ in range(n))
    rows, want = [], {}
    for c in range(40):
        said = []
        for t in range(12):
            own = [words(int(r.integers(4, 12))) for _ in range(int(r.integers(1, 6)))]
            quoted = int(r.integers(t)) if t and r.random() < 0.7 else None
            head = []
            if quoted is not None:
                lines = said[quoted]
                a = int(r.integers(len(lines)))
                head = [f"> {x.upper() if r.random() < 0.2 else x}" for x in lines[a : a + int(r.integers(1, 4))]]
                want[c, t] = quoted
            said.append(own)
            rows.append((c, t, "\n".join(head + own)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4)
    got = {(x.conv_id, x.turn): x for x in quotation_linking.reply_order(df).collect()}
    assert sum(got[k].reply_to == v for k, v in want.items()) >= 0.99 * len(want)
    assert all(x.reply_to is None for k, x in got.items() if k not in want)
    for c in range(40):  # pre-order: a message's thread is not interrupted
        path = []
        for x in sorted((x for x in got.values() if x.conv_id == c), key=lambda x: x.position):
            del path[x.depth :]
            assert (path[-1] if path else None) == x.reply_to
            path.append(x.turn)
            assert path[0] == x.thread_root


def test_long_thread(spark):
    rows = [(1, 0, "start 0")] + [(1, t, f"> start {t - 1}\nstart {t}") for t in range(1, 200)]
    got = quotation_linking.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3)).collect()
    assert all((r.depth, r.position, r.thread_root) == (r.turn, r.turn, 0) for r in got) and len(got) == 200


def test_quotation_linking_of_one_hot_conversation(spark):
    """One conversation in many ranges; a passage said and quoted again and again."""
    said = lambda t: t % 50 == 0
    rows = [(7, t, "Same words here" if said(t) else "> same  WORDS here\nyes") for t in range(3000)] + [(7, None, "> Same words here"), (None, 3, "> Same words here")]
    rows += [(8, 0, "alone")] * 40
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = quotation_linking.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    hot = [r for r in got if r.conv_id == 7]
    assert len(got) == len(rows) and len(hot) == 3001
    for r in hot:
        assert r.reply_to == (None if r.turn is None or said(r.turn) else (r.turn - 1) // 50 * 50)
    key = lambda r: (r.reply_to if r.reply_to is not None else -1 if r.turn is None else r.turn, -1 if r.turn is None else r.turn)
    assert [r.position for r in sorted(hot, key=key)] == list(range(3001))
    assert sorted(r.position for r in got if r.conv_id == 8) == list(range(40))
    assert tuple(next(r for r in got if r.conv_id is None).origin) == (7, 0)


def test_quotation_linking_stays_native(spark, sf_dir):
    plan = queries.op2_quotation_linking(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_fm_is_a_sum_over_pairs():
    m = fm_classifier.FactorisationMachine(20, 3)
    r = np.random.default_rng(0)
    m.w0, m.w, m.v = 0.3, r.standard_normal(20).astype(np.float32), r.standard_normal((20, 3)).astype(np.float32)
    index, value = np.array([1, 4, 7, 2, 19]), np.array([0.5, 1, 2, 0.1, 0.7], np.float32)
    got = m.raw(np.array([0, 3, 5]), index, value)[0]
    for k, at in enumerate((slice(0, 3), slice(3, 5))):
        i, x = index[at], value[at]
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[k] == pytest.approx(m.w0 + m.w[i] @ x + pairs, rel=1e-4)


def test_features_against_plain_counts():
    import re
    from collections import Counter

    from tesselwork.llm._text import text_chunks
    import pyarrow as pa

    texts = ["One two two THREE.\none two", "", "é é é x1 9 $$", "word " * 300]
    meta = np.array([[np.nan], [-3.0], [0.0], [1500.0]])
    for _, _, data, offsets in text_chunks(pa.array(texts)):
        first, index, value = fm_classifier.features(data, offsets, meta)
    for i, t in enumerate(texts):
        own, v = index[first[i] : first[i + 1]], value[first[i] : first[i + 1]]
        words = Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
        hashed = own < fm_classifier.BUCKETS
        damped = sorted(1 + np.log(c) for c in words.values())
        assert np.allclose(sorted(v[hashed]), np.array(damped) / max(np.linalg.norm(damped), 1e-9), atol=1e-6)
        assert (~hashed).sum() == len(fm_classifier._BINS) + 1 and np.all(v[~hashed] == 0.5)
        base = fm_classifier.BUCKETS + fm_classifier._STRUCTURE
        assert own[own >= base].tolist() == [base + (41, 40, 0, 10)[i]]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_fm_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert all(0 <= s <= 1 for s in good + bad)
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (None, "c"), (3, "a b"), (4, "x" * 100000)], "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("_text", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (3, 0), (3, 1), (9, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        got = fm_classifier.score(docs, fm_classifier.train(docs, some)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    known = docs.withColumn("n", F.when(F.col("doc_id") > 2, F.col("doc_id") * -7.5 + 23))
    got = fm_classifier.score(known, fm_classifier.train(known, labels, metadata=("n", "doc_id")), keep=("text", "doc_id")).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert fm_classifier.score(docs.limit(0), fm_classifier.FactorisationMachine()).collect() == []


LONG = "The house on the hill was built by the people of the town, and it is the oldest of all the houses that are in the valley; they say that it was there before the river. "
PAGES = {
    "plain": (f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Old &amp; new</h1><p>{LONG * 2}<p>Short.</p><p><b>Bold<br>line<div class='ad'>Buy the best of the things</div></article><footer>The end of the page</footer></body></html>", f"Old & new\n{LONG.strip()} {LONG.strip()}\nShort.\nBold line"),
    "divs": (f"<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=sidebar><p>{LONG}</p></div><div><h2>Head</h2><p>{LONG * 2}</p><p>In between.</p><p>{LONG * 2}</p></div><form><label>Name</label><input></form><div class='comments'><p>{LONG * 2}</p></div></body>", f"Head\n{(LONG * 2).strip()}\nIn between.\n{(LONG * 2).strip()}"),
    "links": (f"<main><p>{LONG * 2}</p><p><a href=x>Read more of this and that here</a></p></main>", (LONG * 2).strip()),
    "cut": (f"<article><p>{LONG}", LONG.strip()),
    "entities": ("<article><p>a&nbsp;&nbsp;b &lt;c&gt;\n&#233; &copy;</p></article>", "a b <c> é ©"),
    "header": ("<header><h1>Site</h1></header><article><header><h1>Title of it</h1><span>12 May</span></header><p>Text.</p></article>", "Title of it\nText."),
    "none": (None, ""), "empty": ("", ""), "junk": ("<<>< p <b", ""), "hidden": ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
}


RUSSIAN = "Старый дом на холме построили жители города, и он старше всех домов долины; говорят, что он стоял здесь раньше реки, и никто этого не помнит. "
MORE = {
    "slugs": (f"<article><h1 id='social'>Social effects</h1><p id='related'>{LONG}</p><h3 id='comments-on-method'>Comments on method</h3><p class='notice'>{LONG}</p><section id='related-work'><p>{LONG}</p></section></article>", f"Social effects\n{LONG.strip()}\nComments on method\n{LONG.strip()}\n{LONG.strip()}"),
    "names": (f"<div class='site-footer'>{LONG * 2}</div><div id='commentList'>{LONG * 2}</div><div class='x ad-banner-2'>{LONG}</div><article><p>{LONG}</p></article>", LONG.strip()),
    "russian": (f"<body><nav><a href=1>Дом</a></nav><div>{RUSSIAN * 2}</div><div>Коротко.</div><div>{RUSSIAN}</div><div><a href=2>Ещё</a> <a href=3>и ещё</a></div></body>", f"{(RUSSIAN * 2).strip()}\nКоротко.\n{RUSSIAN.strip()}"),
    "short": ("<body><div>Only this.</div></body>", "Only this."),
    "quotes": ("<article><p title=\"a > b\">one</p><p title='open>two</p><p>three</p></article>", "one\ntwo\nthree"),
}


def test_main_text_of_names_languages_and_quotes():
    for name, (page, text) in MORE.items():
        assert html_blocks.main_text(page) == text, name


def test_main_text_takes_time_in_proportion():
    import time

    began = time.perf_counter()
    for page in ("<a href=\"x " * 60_000, "<div>" * 60_000 + "</section>" * 60_000, "<p title='" * 60_000, "<" * 300_000, "<!--" * 60_000):
        html_blocks.main_text(page)
    assert time.perf_counter() - began < 30


def test_articles_without_their_element(spark):
    """The block rules alone find the article of a page whose markup does not name it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    plain = [(html_blocks.main_text(r.html), html_blocks.main_text(r.html.replace("article>", "div>"))) for r in pages]
    assert sum(a == b for a, b in plain) >= 0.98 * len(plain)


def test_second_pass_against_every_distance():
    import random

    random.seed(8)
    for _ in range(300):
        found = [html_blocks._Block("x" * 80, 0, 0, False, random.random() < 0.2) for _ in range(random.randrange(1, 9))]
        for b in found:
            b.label = random.choice([None, "good", "bad"])
        given = [b.label for b in found]
        if "good" not in given:
            continue
        html_blocks._second_pass(found)
        for i, b in enumerate(found):
            near = {s: min((abs(i - j), x) for j, x in enumerate(given) if x and (j > i) == s and j != i) if any(x and (j > i) == s and j != i for j, x in enumerate(given)) else None for s in (False, True)}
            if given[i]:
                want = given[i]
            elif b.heading and near[True]:
                want = near[True][1]
            else:
                least = min(x[0] for x in near.values() if x)
                want = "good" if any(x and x == (least, "good") for x in near.values()) else "bad"
            assert b.label == want


def test_main_text(spark):
    for name, (page, text) in PAGES.items():
        if name != "junk":
            assert html_blocks.main_text(page) == text, name
    df = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(PAGES.values())] + [(0, "u", PAGES["plain"][0])], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_blocks.extract(df).collect()
    assert len(got) == len(PAGES) + 1 and all(r.n_chars == len(r.text) for r in got)
    assert html_blocks.extract(df.limit(0)).collect() == []


def test_main_text_of_pages(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        import html as h
        import re

        want = [" ".join(h.unescape(re.sub(r"<br>|<b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert html_blocks.main_text(r.html).split("\n") == [w for w in want if w], r.page_id


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], sf_dir), "test-stage"))
    assert all(d.columns == list(corpus_pipeline.COLUMNS) for d in seen[1:-1])
    texts = [{r.doc_id: r for r in d.collect()} for d in seen]
    assert all(r.n_chars == len(r.text) for d in texts[1:-1] for r in d.values())
    ids, sets = sorted(texts[2]), {i: brute.shingles(r.text) for i, r in texts[2].items()}
    want = brute.components(ids, lambda a, b: not (sets[a] | sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert set(texts[3]) == set(want.values())
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {x[0]: x for x in brute.contamination([(i, r.text) for i, r in texts[3].items()], items)}
    assert set(texts[4]) == {i for i, x in hit.items() if x[3] < 2}
    assert all(texts[4][i].text == texts[3][i].text for i in texts[4] if hit[i][2] == 0)
    assert all(x[2] == 0 for x in brute.contamination([(i, r.text) for i, r in texts[4].items()], items))
    assert all(r.taken == r.size * r.repeats and 1 <= r.repeats <= 3 and r.text == texts[4][r.doc_id].text for r in texts[5].values())


def test_pipeline_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a text without an id but of some length", None, "s", 5), (3, "w " * 20000, "en", None, None), (3, "another text with the same id, long enough", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs.withColumn("extra", F.lit(1)), sf_dir)
            assert out.count() <= len(rows), name


def test_pipeline_keeps_rows_not_ids(spark, sf_dir):
    """Ids that stand on several texts, repeated rows and rows without an id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (1, a), (3, b), (3, b), (None, c), (None, c + " end"), (None, b), (7, ""), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()), key=str)
    assert [x for x in got if x[0] is not None] == [(1, a), (3, b), (5, None)]
    assert [x[1] in (c, c + " end") for x in got if x[0] is None] == [True]
    dropped = corpus_pipeline.lines(spark, df, sf_dir).collect()
    assert sum(r.text == a for r in dropped) == 1 and sum(r.text == b for r in dropped) <= 2
    mixed = corpus_pipeline.mix(spark, df, sf_dir).collect()
    assert all(r.taken == r.size * r.repeats for r in mixed)


def test_pipeline_cuts_what_a_cut_brings_together(spark, tmp_path):
    item = "one two three four five six seven eight"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(1, f"start one two three {item} four five six seven eight end", "en", "s", 1), (2, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.decontaminate(spark, df, str(tmp_path)).collect()}
    assert got[1].split() == ["start", "end"] and got[2] == "clean"
