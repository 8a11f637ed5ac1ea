"""The pipeline's stages against brute force, and on odd tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import bpe, simhash_wide
from tessera.llm.common import save

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASH = "rid long, sig string, n_lines long, n_dropped long, kept_text string, kept struct<n_lines:long>, text_key long, _d long, _k long, item_id long, score double, row string, uid long"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def changed(rng, text, share):
    w = text.split()
    for k in rng.sample(range(len(w)), int(len(w) * share)):
        w[k] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Empty benchmark and labels, and a writer of documents."""
    base = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "Which river runs through the old town of Bern before it reaches the lake and the hills beyond?"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def written(spark, tmp_path, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/d")


def odd_rows():
    rng = random.Random(3)
    long = prose(rng, 250_000)  # about 2 MB
    t, u = prose(rng, 120), prose(rng, 90)
    texts = [(1, t), (2, t), (2, u), (2, u), (None, t), (None, None), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, changed(rng, long, 0.002)), (8, "one"), (9, "one")]
    return [(i, x, None, None, None) for i, x in texts]


def clash(rows):
    return [(*r, 7, "s", 777, 778, "k", (779,), 780, 781, 782, 783, 0.5, "row", 784) for r in rows]


@pytest.mark.parametrize("extra", [False, True])
def test_stages_on_odd_rows(spark, tables, tmp_path, extra):
    rows = clash(odd_rows()) if extra else odd_rows()
    docs = written(spark, tmp_path, rows, f"{DOCS}, {CLASH}" if extra else DOCS)
    before = docs
    for name, stage in cp.STAGES[:-1]:
        out = save(stage(spark, docs, tables), name)
        assert out.columns == before.columns, name
        docs = out
    got = sorted((r.doc_id if r.doc_id is not None else -1, len(r.text) if r.text is not None else -1) for r in docs.collect())
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    # Of t the first document, of u one row, of the long ones one, of "one" one; what has no word stays.
    want = [(1, len(rows[0][1])), (2, len(rows[2][1])), (-1, -1), (-1, -1), (3, -1), (4, 0), (5, 4), (6, len(texts[6])), (8, 3)]
    assert got == sorted(want)
    if extra:
        assert {(r.rid, r.sig, r.n_lines, r.n_dropped, r.kept_text, r.kept.n_lines, r.text_key, r["_d"], r["_k"], r.uid) for r in docs.collect()} == {(7, "s", 777, 778, "k", 779, 780, 781, 782, 784)}
    last = cp.STAGES[-1][1](spark, docs, tables)
    assert last.count() == len(want)


def test_stages_on_an_empty_table(spark, tables, tmp_path):
    docs = written(spark, tmp_path, [])
    for _, stage in cp.STAGES:
        docs = save(stage(spark, docs, tables), "empty")
        assert docs.count() == 0
    assert docs.columns == bpe.digests(docs.withColumn("text", F.lit(None).cast("string"))).columns


def test_near_copies_against_brute_force(spark, tables, tmp_path):
    rng = random.Random(8)
    base = [prose(rng, rng.randint(60, 400)) for _ in range(60)]
    texts = base + [changed(rng, t, s) for t in base[:40] for s in (0.004, 0.01, 0.015)] + base[40:45]
    rng.shuffle(texts)
    docs = written(spark, tmp_path, [(i, t, None, None, None) for i, t in enumerate(texts)])
    kept = {r.doc_id for r in cp.simhash_stage(spark, docs, tables).collect()}
    sets = [shingles(t) for t in texts]
    alike = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    # A document goes only where a smaller one reaches it over pairs that are about alike; sure pairs are all found.
    for i in range(len(texts)):
        near = [j for j in range(len(texts)) if j != i and alike[i][j] >= 0.7]
        if i not in kept:
            assert near
        if any(j < i and alike[i][j] >= 0.88 for j in range(len(texts))):
            assert i not in kept
        if not near:
            assert i in kept


def test_recall_at_the_least_similarity():
    """Nine in ten pairs of 0.80 to 0.82 are linked at any number of texts, by a shared cell and few enough differing bits."""
    rng = random.Random(4)
    grids = {n: simhash_wide.grid(n, 0.8) for n in (1, 10**6, 10**9)}
    assert grids[1][0] == 6 and grids[10**9][0] == 15
    found, n = dict.fromkeys(grids, 0), 0
    most = simhash_wide.limit(0.8)
    while n < 200:
        a = prose(rng, 300)
        b = changed(rng, a, 0.022)
        x, y = shingles(a), shingles(b)
        if not 0.8 <= len(x & y) / len(x | y) < 0.82:
            continue
        w = np.frombuffer(simhash_wide.signature(a, 5) + simhash_wide.signature(b, 5), "<u8").reshape(2, -1)
        near = np.bitwise_count(w[0, : simhash_wide.CHECK] ^ w[1, : simhash_wide.CHECK]).sum() <= most
        n += 1
        for k, grid in grids.items():
            c = simhash_wide.cells(w, *grid)
            found[k] += bool(near and (c[0] == c[1]).any())
    print({k: f"linked {v / n:.2f}" for k, v in found.items()})
    assert all(v / n >= 0.9 for v in found.values())


@pytest.mark.parametrize("held", [200_000, 4])
def test_links_connect_what_shares_a_cell(spark, held):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (6, simhash_wide.WORDS)).astype(np.uint64)
    words = []
    for b in base:
        for _ in range(30):
            x = np.unpackbits(b.view(np.uint8))
            x[rng.random(len(x)) < 0.04] ^= 1
            words.append(np.packbits(x).view(np.uint64))
    w = np.array(words)
    units = spark.createDataFrame([(i, bytearray(x.astype("<u8").tobytes())) for i, x in enumerate(w)], "uid long, sig binary")
    most = simhash_wide.limit(0.8)
    grid = simhash_wide.grid(10**6, 0.8)
    c, head = simhash_wide.cells(w, *grid), w[:, : simhash_wide.CHECK]
    parent = list(range(len(w)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = lambda i, j: (c[i] == c[j]).any() and np.bitwise_count(head[i] ^ head[j]).sum() <= most
    for i in range(len(w)):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    got = list(range(len(w)))
    for r in simhash_wide.links(units, most, *grid, held).collect():
        assert linked(r.a, r.b)
        a, b = got[r.a], got[r.b]
        got = [b if x == a else x for x in got]
    same = lambda of: {frozenset(i for i in range(len(w)) if of(i) == of(k)) for k in range(len(w))}
    assert same(find) == same(lambda i: got[i])


def test_the_manhattan_distance_never_exceeds_the_bits():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 2000)).astype(np.uint64)
    m = simhash_wide.manhattan(simhash_wide.points(a), simhash_wide.points(b))
    slow = [sum(abs((int(x) >> k & 3).bit_count() - (int(y) >> k & 3).bit_count()) for k in range(0, 64, 2)) for x, y in zip(a, b, strict=True)]
    assert m.tolist() == slow and (m <= np.bitwise_count(a ^ b)).all()


def test_toxicity_and_decontamination_decide(spark, tmp_path):
    rng = random.Random(6)
    bad = ["moronic", "worthless", "disgusting"]
    rows, labels = [], []
    for i in range(400):
        w, toxic = prose(rng, 60).split(), i % 4 == 0
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, 0, int(toxic)))
    item = "Which river runs through the old town of Bern before it reaches the lake and the hills beyond?"
    rows += [(1000, f"{prose(rng, 30)}. {item} {prose(rng, 30)}", None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = written(spark, tmp_path, rows)
    kept = {r.doc_id for r in cp.toxicity_stage(spark, docs, str(tmp_path)).collect()}
    right = sum((i in kept) == (i % 4 != 0) for i in range(400))
    assert right / 400 > 0.95 and 1000 in kept
    assert {r.doc_id for r in cp.decontamination_stage(spark, docs, str(tmp_path)).collect()} == set(range(400))


def test_lines_and_ids_of_the_whole_run(spark, tables, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"{prose(rng, 40)}\n A shared LINE\n{prose(rng, 40)}", None, None, 1) for i in range(12)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(12))
    for i, text, *_ in rows:
        ids = want.encode_ordinary(text.replace("\n A shared LINE", ""))
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
