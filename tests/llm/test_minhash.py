"""Near copies by b-bit MinHash against brute force, and on odd tables."""

import random

import numpy as np
import pytest

from tessera.llm import minhash
from tests.llm.test_operators import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_set(text, size=4):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if x]
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def slow_components(texts):
    sets = {i: slow_set(t) for i, t in texts.items()}
    comp = {i: i for i in texts}
    find = lambda x: x if comp[x] == x else find(comp[x])
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def texts():
    """Base texts with copies of all degrees of change around the threshold, a large group, chains, few words, odd white space."""
    rng = random.Random(7)
    out = []
    for n in (5, 8, 12, 60, 200, 900):
        base = words(rng, n).split()
        out.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.05, 0.1, 0.3):
            w = list(base)
            for k in rng.sample(range(n), max(1, int(share * n))):
                w[k] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(w))
    chain = words(rng, 100).split()
    for step in range(12):
        chain[8 * step : 8 * step + 3] = [f"step{step}x", f"step{step}y", f"step{step}z"]
        out.append(" ".join(chain))
    hot = words(rng, 120).split()
    for _ in range(70):
        w = list(hot)
        for k in rng.sample(range(120), rng.randrange(9)):
            w[k] = f"hot{rng.randrange(10**6)}"
        out.append(" ".join(w))
    out += [out[3], out[3].upper(), out[3].replace(" ", " \t\n"), None, "", " \n", "one", "One", "one two three", "one\ttwo three", "é ß É", "é ß é", "a b c d", "a b c d e"]
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("held", [{}, {"held_bucket": 10, "held_sets": 2000, "held_rows": 0}])
def test_links_as_by_brute_force(spark, texts, held):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, digest string")
    got = {r.doc_id: r for r in minhash.near_copies(docs.repartition(3), **held).collect()}
    want = slow_components(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_odd_rows(spark):
    rows = [(None, "same text here once more", 1), (7, "same text here once more", 2), (7, "same text here once more", 2), (8, None, 3), (None, None, 4), (None, "only here, without any id", 5), (9, "", 6), (9, "word " * 300_000, 7), (4, "word " * 300_001, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in minhash.near_copies(docs).collect())
    assert got == sorted([(-1, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True), (-1, 0, -1, True), (-1, 2, -1, True), (9, 0, 9, True), (9, 1, 4, False), (4, 1, 4, True)])
    assert minhash.near_copies(docs.limit(0)).collect() == []


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.3, 0.6, 0.8, 0.9):
        for _ in range(60):
            n = int(300 * share * 2 / (1 + share))
            both = rng.integers(0, 1 << 63, n, np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 300 - n, np.uint64)])) for _ in range(2))
            sig = [np.frombuffer(minhash.packed(minhash.minima(x)), "<u8")[None] for x in (a, b)]
            m = minhash.unequal(*sig)[0] / minhash.HASHES
            errors.append(1 - m / (1 - 2.0**-minhash.BITS) - n / (600 - n))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
