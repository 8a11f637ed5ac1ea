"""The operators against brute force, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, exactdedup, language, linededup, passages, simhash, substrings, tokenfile, toxicity
from tessera.llm.bitfilter import bit_filter, hits
from tessera.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = " \t\n\x0b\x0c\r"


def words(rng, n, size=40):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages and lines, odd white space, nulls, repeated rows, a long text."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 160)) for _ in range(40)]
    passage = words(rng, 70)
    out = list(base)
    out += base[:8] + [t.replace(" ", "  \t") for t in base[8:12]]
    for t in base[12:20]:
        w = t.split()
        w[len(w) // 2] = "CHANGED"
        out.append(" ".join(w))
    out += [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(15)]
    out += [f"{words(rng, 5)}\nA common LINE \n{words(rng, 5)}\n\n" for _ in range(12)]
    out += [None, "", None, " \n ", "é ß 日本 don't  stop", "ab " * 4000, "x" * 500, "\n\n\n", "A\x1cB \x00 c"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null ids, repeated rows, a clashing extra column, null everything."""
    rows = [(None, None, None, None, None, 1), (None, "same text here", "en", "s", 3, 2), (7, "same text here", "en", "s", 3, 2), (7, "same text here", "en", "s", 3, 2), (8, "z " * 300, None, None, None, 3)]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, DOCS + ", n_lines long").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- op 7 and op 3 ----------------------------------------------------------------------
def test_bpe_equals_tiktoken(docs, texts):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, dig = by_id(bpe.encode(docs)), by_id(bpe.digests(docs))
    for i, t in enumerate(texts):
        ids = want.encode_ordinary(t or "")
        assert got[i].ids == ids
        assert bytes(got[i].decoded) == (t or "").encode()
        assert dig[i].n_tokens == len(ids)
        assert dig[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_on_random_text():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own, want = bpe.Bpe(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, memo = random.Random(1), own.memo()
    for _ in range(3000):
        t = "".join(rng.choice("aabcde  \n\t'sréß€日本0123 \x1c.,!\0\xa0") for _ in range(rng.randint(0, 50)))
        assert np.frombuffer(memo.ids(t), "<u4").tolist() == want.encode_ordinary(t)


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 20])
def test_packing_round_trip_and_random_access(bits):
    a = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    p = tokenfile.pack(a, bits)
    assert len(p) == -(-1001 * bits // 8)
    assert (tokenfile.unpack(p, bits, 0, 1001) == a).all()
    assert (tokenfile.unpack(p, bits, 37, 500) == a[37:537]).all()


def test_token_file(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenfile.write(docs, f"file://{tmp_path}/t", block_ids=64, blocks_a_file=3)
    got, start = by_id(tokenfile.with_starts(tokenfile.read(spark, f"file://{tmp_path}/t"))), 0
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# --- op 4 -------------------------------------------------------------------------------
def line_truth(rows, least=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WHITE).translate(lower)
    n = Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least or not key(x)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("held", [1000, 0])
def test_line_dedup(docs, texts, held):
    got = by_id(linededup.drop_lines(docs, linededup.LineIndex.build(docs), held_keys=held))
    for i, (n, dropped, kept) in enumerate(line_truth(texts)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (n, dropped, kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_line_index_is_reversible(docs):
    half = docs.where("doc_id % 2 = 0")
    index = linededup.LineIndex.build(docs, 4)
    back = index.delete(half).insert(half)
    rows = lambda df: sorted(tuple(map(bytes, r)) if len(r) == 1 else (bytes(r[0]), r[1]) for r in df.collect())
    assert rows(back.counts) == rows(index.counts)
    less = index.delete(half)
    assert rows(less.counts) == rows(linededup.LineIndex.build(docs.where("doc_id % 2 = 1"), 4).counts)
    a = {r.doc_id: r.kept_sha256 for r in linededup.drop_lines(docs, less).collect()}
    b = {r.doc_id: r.kept_sha256 for r in linededup.drop_lines(docs, linededup.LineIndex.build(docs.where("doc_id % 2 = 1"), 4)).collect()}
    assert a == b


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    d = rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    f = linededup.CuckooFilter.of(d)
    assert f.has(d).all()
    f.delete(d[:1000])
    assert f.has(d[1000:]).all()
    assert f.has(d[:1000]).mean() < 0.05
    assert linededup.CuckooFilter.frombytes(f.tobytes()).has(d[1000:]).all()


# --- op 5 -------------------------------------------------------------------------------
def test_exact_dedup(docs, texts):
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    got = by_id(exactdedup.exact_groups(docs, first=4, growth=2))
    for i, t in enumerate(norm):
        g = groups[t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (g[0], len(g), g[0] == i, hashlib.sha256(t.encode()).hexdigest())


# --- op 6 -------------------------------------------------------------------------------
def slow_fingerprint(text, size):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(spark, docs, texts):
    got = by_id(simhash.fingerprints(docs))
    for i, t in enumerate(texts):
        assert got[i].fp & (2**64 - 1) == slow_fingerprint(t, 3)
    one = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert one & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def slow_components(fps, distance=3):
    ids, parent = sorted(fps), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: min(j for j in ids if find(j) == find(i)) for i in ids}


def test_near_duplicates(docs, texts):
    fps = {i: slow_fingerprint(t, 3) for i, t in enumerate(texts)}
    want = slow_components(fps)
    got = by_id(simhash.near_duplicates(docs))
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("dense", [256, 1])
def test_links_connect_all_within_distance(spark, dense):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << k
            fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense=dense).distinct()
    for r in found.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3
    comp = {r.id: r.component for r in components(found).collect()}
    want = slow_components({x: x & (2**64 - 1) for x in signed})
    assert {x: comp.get(x, x) for x in signed} == want


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(63) * rng.choice((1, -1)), rng.getrandbits(63)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    m, h = simhash.manhattan(simhash.popcounts(F.col("a")), simhash.popcounts(F.col("b"))), simhash.hamming(F.col("a"), F.col("b"))
    for r in df.select("a", "b", m.alias("m"), h.alias("h")).collect():
        bits = lambda x: [(x >> 2 * k & 3).bit_count() for k in range(32)]
        assert r.m == sum(abs(x - y) for x, y in zip(bits(r.a), bits(r.b), strict=True)) <= r.h


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- op 8 -------------------------------------------------------------------------------
def slow_removal(rows, width=200):
    data = [(t or "").encode() for t in rows]
    n = Counter(d[p : p + width] for d in data for p in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - width + 1):
            if n[d[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), len(d) - len(kept), sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1])), kept))
    return out


def test_repeated_bytes(docs, texts):
    got = by_id(substrings.remove(docs))
    for i, (n, removed, spans, kept) in enumerate(slow_removal(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (n, removed, spans, kept)


def test_bit_filter_never_misses(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    data = bit_filter(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert hits(data, keys).all()
    assert hits(data, np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5000)).mean() < 0.1


# --- op 9 -------------------------------------------------------------------------------
def test_decontamination_finds_reworded_slots(spark):
    item = "Yesterday the trader Anna Smith bought 12 apples and 30 pears for 5.50 dollars at the market, then Anna Smith sold 12 apples to the neighbour."
    b = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    rows = [
        (1, "before it all. " + item.replace("Anna Smith", "Bob Jones").replace("12", "99").replace("30", "31") + " after it"),
        (2, "Yesterday the trader Bob Jones bought 99 apples and 31 pears for 7 euros at the market, then Carl Hill sold 98 apples to the neighbour."),
        (3, None), (4, ""), (5, item), (5, "another text"), (None, item), (6, "The quick brown fox jumps over the lazy dog again and again."),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 1), (5, 1), (None, 1)}
    assert {(r.doc_id, r.text) for r in decontaminate.clean(d, b).collect()} == {(2, rows[1][1]), (3, None), (4, ""), (5, "another text"), (6, rows[-1][1])}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, held_windows=0).collect()} == got


# --- op 10 ------------------------------------------------------------------------------
def test_passages(docs, texts):
    n = defaultdict(set)
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        for k in range(len(w) - passages.LEAST + 1):
            n[tuple(w[k : k + passages.LEAST])].add(i)
    must = {i for s in n.values() if len(s) > 1 for i in s}
    got = by_id(passages.shared_passages(docs))
    assert must <= set(got)
    # Documents without a near counterpart stay out: the first twenty of the unshared ones are random words.
    lonely = set(range(20, 40)) - must
    assert not lonely & set(got)


def test_chains_prefer_the_diagonal():
    a = np.array([0, 5, 10, 15, 18, 20, 25])
    b = np.array([100, 105, 110, 115, 3, 120, 125])
    order = np.lexsort((b, a))
    assert passages.best_chains(a[order], b[order])[0] == [0, 1, 2, 3, 5, 6]


def test_alignment_counts_changed_words():
    a = np.arange(100, dtype=np.uint64)
    b = a.copy()
    b[50] = 9999
    lo_a, hi_a, lo_b, hi_b, alike = passages.align(a, b, [10, 70], [10, 70])
    assert (lo_a, hi_a, lo_b, hi_b) == (0, 100, 0, 100)
    assert alike == pytest.approx(0.99)


# --- op 1 and op 2 ----------------------------------------------------------------------
def toxic_rows(n, seed, bad):
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = words(rng, 60).split()
        label = rng.random() < 0.3
        for _ in range(4 * label):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((" ".join(w), int(label)))
    return out


def test_toxicity_learns_and_reaches_misspellings():
    rows = toxic_rows(500, 1, ["moronic", "worthless", "disgusting"])
    model = toxicity.train([t for t, _ in rows], np.array([y for _, y in rows]))
    held = toxic_rows(200, 2, ["moronic", "worthless", "disgusting"])
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in held]) > 0.95
    spelt = toxic_rows(200, 3, ["moronick", "worthlesss", "disgustingg"])
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in spelt]) > 0.85
    assert 0 <= model.score(None) <= 1


def test_toxicity_without_labels():
    assert 0 <= toxicity.train([], np.array([], np.int64)).score("x") <= 1
    assert toxicity.train(["a", "b"], np.array([1, 1])).score("a") > 0.5


def test_language_fuses_evidence(spark):
    de, fr = "der hund und die katze sind nicht hier und das ist gut ", "le chien et la chatte ne sont pas ici et tout va bien "
    rows = [(i, (de if i % 2 else fr) * 3, "de" if i % 2 else "fr") for i in range(40)]
    model = language.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    ask = [(1, de, None, None), (2, fr, "fr", "a.example.fr"), (3, None, "de", None), (4, "", None, "b.example.fr"), (5, fr, None, "b.example.fr"), (6, fr, None, "b.example.fr"), (7, fr, None, "b.example.fr")]
    got = by_id(language.identify(spark.createDataFrame(ask, "id long, text string, declared string, host string"), model), "id")
    assert [got[i].lang for i in (1, 2, 3, 4, 5)] == ["de", "fr", "de", "fr", "fr"]
    assert got[3].text_lang is None
    assert all(0 < r.confidence <= 1 + 1e-9 for r in got.values())


def test_page_evidence(spark):
    df = spark.createDataFrame([("http://u:p@WWW.Ex.de:80/x", '<!doctype html><HTML class=a lang="DE-at"><script>var t="<p>x";</script><p>Hallo &amp; Welt</p>')], "url string, html string")
    r = df.select(language.host_of(F.col("url")), language.declared_of(F.col("html")), F.trim(language.text_of(F.col("html")))).first()
    assert (r[0], r[1]) == ("www.ex.de", "de") and r[2].split() == ["Hallo", "Welt"]


# --- odd and empty tables ---------------------------------------------------------------
def run_all(spark, docs, tmp):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    tokenfile.write(docs, f"file://{tmp}/t")
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    out = {
        1: language.identify(rows, language.fit(language.training_rows(docs))),
        2: toxicity.classify(docs, toxicity.fit(docs, labels)),
        3: tokenfile.with_starts(tokenfile.read(spark, f"file://{tmp}/t")),
        4: linededup.drop_lines(docs, linededup.LineIndex.build(docs, 2)),
        5: exactdedup.exact_groups(docs),
        6: simhash.near_duplicates(docs),
        7: bpe.digests(docs),
        8: substrings.remove(docs),
        9: decontaminate.clean(docs, bench),
        10: passages.shared_passages(docs),
    }
    return {k: v.collect() for k, v in out.items()}


def test_odd_table(spark, odd, tmp_path):
    got = run_all(spark, odd, tmp_path)
    assert {k: len(v) for k, v in got.items() if k != 10} == dict.fromkeys((1, 2, 3, 4, 5, 6, 7, 8, 9), 5)
    same = [r for r in got[5] if r.group_size == 3]
    assert len(same) == 3 and {r.keep_id for r in same} == {7} and sum(r.kept for r in same) == 2
    assert not got[10] or all(r.doc_id == 8 for r in got[10])


def test_empty_table(spark, empty, tmp_path):
    assert all(v == [] for v in run_all(spark, empty, tmp_path).values())


def test_links_of_cells_too_full_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 3)
    rng = random.Random(9)
    base = rng.getrandbits(63)
    fps = {base}
    while len(fps) < 8:
        x = base
        for k in rng.sample(range(63), rng.randint(1, 5)):
            x ^= 1 << k
        fps.add(x)
    comp = {r.id: r.component for r in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), dense=1).distinct()).collect()}
    assert {x: comp.get(x, x) for x in fps} == slow_components({x: x for x in fps})


def test_links_at_wider_distances(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(63) for _ in range(4)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for k in rng.sample(range(63), rng.randint(1, 9)):
                x ^= 1 << k
            fps.add(x)
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 6, 9, 4, 64).distinct()
    comp = {r.id: r.component for r in components(found).collect()}
    assert {x: comp.get(x, x) for x in fps} == slow_components({x: x for x in fps}, 6)
