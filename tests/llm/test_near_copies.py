"""Near copies by five-word shingles, against every pair."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tesselwork.llm import shingle_copies, simhash_popcount
from tesselwork.llm._text import mix

from . import brute


def shingles(text, n=5):
    w = brute.SPACE_WORD.findall(brute.lower_ascii(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def copies(seed, groups, size, changed):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [f"w{r.randrange(10**6)}" for _ in range(300)]
        for _ in range(size):
            own = list(words)
            for at in r.sample(range(300), r.choice(changed)):
                own[at] = f"x{r.randrange(10**6)}"
            out.append(" ".join(own))
    return out


def expected(texts):
    sets = [shingles(t) for t in texts]
    return brute.components(range(len(texts)), lambda a, b: not (sets[a] | sets[b]) or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)


@pytest.mark.parametrize("few", [32, 2])
def test_near_copies(spark, monkeypatch, few):
    monkeypatch.setattr(shingle_copies, "FEW", few)
    monkeypatch.setattr(shingle_copies, "BLOCK", 4)
    texts = copies(1, 6, 6, [0, 2, 5, 7, 40]) + [None, "", " \n", "one", "ONE ", "one two", "a b c d e f", "a b c d e g"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = shingle_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)).collect()
    assert len(got) == len(texts)
    assert {r.id: r.component for r in got} == expected(texts)
    assert shingle_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pipeline_stage_takes_copies_beyond_two_bits(spark):
    texts = copies(2, 5, 2, [3])
    assert sum((brute.fingerprint(a) ^ brute.fingerprint(b)).bit_count() > 2 for a, b in zip(texts[::2], texts[1::2])) >= 3
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(expected(texts).values()) == {0, 2, 4, 6, 8}


def test_sketches():
    """Against a sum of bits one by one; rows of over 255 hashes too."""
    r = random.Random(3)
    rows = [[r.getrandbits(64) for _ in range(n)] for n in (1, 2, 5, 255, 256, 700)]
    factors = np.array([1, 2 * r.getrandbits(62) + 1], np.uint64)
    got = simhash_popcount.sketches(np.array(sum(rows, []), np.uint64), np.array([len(x) for x in rows]), factors)
    for x, fps in zip(rows, got.tolist()):
        for factor, fp in zip(factors, fps):
            spread = mix(np.array(x, np.uint64) * factor).tolist()
            bits = [2 * sum(h >> at & 1 for h in spread) > len(x) for at in range(64)]
            assert fp == sum(bits[8 * i + j] << 8 * j + i for i in range(8) for j in range(8))


def test_cells_find_pairs_just_at_the_similarity(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**9)}"
    texts = []
    for n in [9, 30, 100, 400] * 25:
        shared = [word() for _ in range(8 * n + 4)]  # of 10 n shingles 8 n are shared: a similarity of 0.8
        texts += [" ".join(shared + [word() for _ in range(n)]), " ".join(shared + [word() for _ in range(n)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.id: x.component for x in shingle_copies.near_copies(df).collect()} == {i: i - i % 2 for i in range(len(texts))}


def test_pipeline_stage_goes_through_simhash(spark, monkeypatch):
    """Copies whose fingerprints are far apart meet in no cell: nothing beside them finds links."""
    texts = copies(5, 3, 2, [1])
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(corpus_pipeline.near_duplicates(spark, df, "").collect()) == 3
    seen = lambda hashes, n, factors: np.bitwise_xor.reduceat(hashes, np.cumsum(n) - n)[:, None] * factors
    monkeypatch.setattr(shingle_copies, "sketches", seen)
    assert len(corpus_pipeline.near_duplicates(spark, df, "").collect()) == 6
