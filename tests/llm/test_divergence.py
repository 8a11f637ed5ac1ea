"""The source audit against plain integers, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string, rank int, n long"


def slow(rows, least=10, top=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in counts if x == lang)
        share = {}
        for s in [*sources, None]:
            n = Counter({t: sum(counts[lang, x][t] for x in (sources if s is None else [s])) for t in kept})
            share[s] = {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(share[s][t], share[None][t]), t) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for i in range(700):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if rng.random() < 0.35 else f"s{rng.randrange(23)}"
        words = [f"{rng.choice(['Ab', 'cD', 'ÉÉ', 'ß', '日本'])}{'xyz'[rng.randrange(3)]}{chr(97 + int(rng.paretovariate(0.7)) % 26)}{'q' * (source == 'hot' and rng.random() < 0.3)}" for _ in range(rng.randint(0, 40))]
        out.append((i, rng.choice([" ", "\n", "1", "_", "[", "\x7f"]).join(words) if rng.random() < 0.98 else None, lang, source, 1, 2))
    out += [(900, "no kept term", "xx", "a", 1, 2), (901, None, "xx", "b", 1, 2), (902, "", "yy", None, 1, 2), (None, None, None, None, None, None)]
    return out + out[:3] + [(903, "Long " * 200_000, "en", "hot", 1, 2)]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3, "stretch": 2, "block": 4}])
def test_the_audit_as_by_plain_integers(spark, rows, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(divergence, "FLUSH", 20)
        monkeypatch.setattr(divergence, "HELD_LANGS", 0)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, **sizes).collect()]
    assert len(got) == len(set(got)) and set(got) == slow(rows)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_shares_and_distances_are_exact(spark):
    rng = random.Random(2)
    cases = [(0, 0, 1), (0, 1, 1), (10**12, 10**13, 10**9)] + [(n := rng.randrange(10**k), n + rng.randrange(10**k), rng.randrange(1, 10**6)) for k in range(1, 14) for _ in range(20)]
    want = [1 + 10**9 * (n + 2) // (of + 2 * v) for n, of, v in cases]
    assert [int(divergence.shares(np.array([n]), of + 2 * v)[0]) for n, of, v in cases] == want
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, of long, v long")
    assert [r.p for r in df.orderBy("i").select(divergence.share(F.col("n"), F.col("of"), F.col("v")).alias("p")).collect()] == want


def test_packed_counts():
    for top in (1, 255, 256, 2**33):
        at, n = np.array([0, 7, 65535]), np.array([1, 0, top])
        back = divergence.unpack(divergence.pack(at, n))
        assert [x.tolist() for x in back] == [at.tolist(), n.tolist()]
    assert [len(x) for x in divergence.unpack(divergence.pack(np.empty(0, int), np.empty(0, int)))] == [0, 0]
