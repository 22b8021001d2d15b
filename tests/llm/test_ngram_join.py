"""The n-gram join's rounds, blocks and hashing against brute force."""

import random

import numpy as np
import pytest

from loam.llm import ngram_join

from .test_operators import prose, shingles


def components_of(texts, n, percent):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t, n) for t in texts]
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in range(len(texts))}, links


def near_copies(count, edits, seed=3):
    """Copies with so many edits that about half of all pairs reach the threshold."""
    rng = random.Random(seed)
    base, out = prose(rng, 150).split(), []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("tops", "block"), [((1, 4, 32), 512), ((1, 4, 32), 8), ((1,), 8), ((1,), 512), ((1, 1), 16)])
def test_group_near_the_threshold(spark, monkeypatch, tops, block):
    """Whatever the rounds leave is found in the blocks; buckets beyond a block go to leaders and block pairs."""
    monkeypatch.setattr(ngram_join, "TOPS", tops)  # read on the driver
    monkeypatch.setattr(ngram_join, "MOST_COMBOS", 4)
    texts = near_copies(90, 6) + near_copies(60, 9, 4) + [prose(random.Random(i), 40) for i in range(20)]
    want, links = components_of(texts, 4, 85)
    assert links > 200 and len(set(want.values())) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs, 4, 85, block).collect()}
    assert got == want


def test_proposals_do_not_grow_with_the_square(spark, monkeypatch):
    """A group of near copies gives a few verified pairs for each document, not all pairs."""
    seen, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *a: (seen.append(pairs.count()), verified(pairs, *a))[1])
    texts = near_copies(300, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, links = components_of(texts, 4, 85)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs, 4, 85).collect()} == want
    assert links > 20_000 and sum(seen) < 40 * len(texts)


def test_words_that_break_polynomial_hashes():
    """Thue-Morse words collide under any polynomial modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for size in (8, 16, 32, 64, 128, 1024):
        a, b = (ngram_join.word_hashes(w[:size].encode())[1].tolist() for w in (word, other))
        assert a != b
    assert ngram_join.word_hashes(b"a a\0 a\0\0")[1].tolist() == list(dict.fromkeys(ngram_join.word_hashes(b"a a\0 a\0\0")[1].tolist()))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(5)
    text = prose(rng, 3000) + " " + "y" * 5000 + "\t\n" + prose(rng, 500) + " \u00e9\u00a0x"
    whole = ngram_join.shingle_sets([text], 4)[0]
    monkeypatch.setattr(ngram_join, "CHUNK", 100)
    assert np.array_equal(ngram_join.shingle_sets([text], 4)[0], whole)
    assert len(whole) == len(shingles(text, 4))
