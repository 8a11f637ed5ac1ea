"""Long texts, repeated ids, clashing names, hot groups, and scans at another parallelism."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, doubling, exactdedup, language, linededup, passages, simhash, substrings, tokenfile, toxicity
from tessera.llm.cuckoo import CuckooFilter
from tests.llm.test_operators import line_truth, slow_removal


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    rng = random.Random(1)
    long = prose(rng, 130_000)  # about a megabyte
    rows = [(1, long), (2, long[:400_000] + " and then " + long[400_000:]), (3, "short"), (4, None)]
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path), dict(rows)


def test_operators_read_long_texts_whole(spark, long_docs, tmp_path):
    docs, texts = long_docs
    by = lambda df: {r.doc_id: r for r in df.collect()}
    got = by(substrings.remove(docs))
    assert got[1].n_removed == len(texts[1]) and got[2].n_removed >= len(texts[1]) - 4 and got[3].n_removed == 0
    found = by(passages.shared_passages(docs))
    assert set(found) == {1, 2} and found[1].n_words == 130_000 and found[1].partner_id == 2
    assert by(exactdedup.exact_groups(docs))[1].group_size == 1
    assert by(simhash.near_duplicates(docs))[2].component_id == 1
    assert bytes(by(bpe.encode(docs))[1].decoded) == texts[1].encode()
    assert by(linededup.drop_lines(docs, linededup.LineIndex.build(docs)))[1].kept_text == texts[1]
    tokenfile.write(docs, f"file://{tmp_path}/t")
    assert by(tokenfile.with_starts(tokenfile.read(spark, f"file://{tmp_path}/t")))[1].n_tokens > 130_000
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert toxicity.classify(docs, model).count() == 4
    item = " ".join(texts[1].split()[50_000:50_020])
    assert {r.doc_id for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {1, 2}
    asked = docs.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lit("h").alias("host"))
    assert language.identify(asked, language.fit(docs.select(F.col("doc_id").alias("id"), "text", F.lit("en").alias("lang")))).count() == 4


# --- op 4 -------------------------------------------------------------------------------
def test_lines_count_documents_and_columns_keep_their_names(spark):
    rows = [(1, "often\nhere", 777, "r")] * 10 + [(k, "other", 777, "r") for k in range(2, 11)] + [(None, "none", 777, "r")] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, _r string")
    index = linededup.LineIndex.build(docs)
    got = linededup.drop_lines(docs, index).collect()
    assert {(r.text, r.n_dropped, r.n_lines, r["_r"], r["_n_lines"]) for r in got} == {("often\nhere", 0, 777, "r", 2), ("other", 0, 777, "r", 1), ("none", 1, 777, "r", 1)}


@pytest.mark.parametrize(("keys", "filters"), [(10**6, 1 << 26), (0, 1 << 26), (0, 1)])
def test_lines_by_all_ways_and_many_shards(spark, monkeypatch, keys, filters):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    rng = random.Random(2)
    texts = ["\n".join(rng.choice([f"line {k}", f" LINE {k}\t", "x" * 40 + str(k)]) for k in rng.choices(range(30), k=12)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = linededup.LineIndex.build(docs)
    assert index.shards >= 8
    got = {r.doc_id: r for r in linededup.drop_lines(docs, index, keys, held_filters=filters).collect()}
    for i, (n, dropped, kept) in enumerate(line_truth(texts)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (n, dropped, kept)


def test_a_filter_holds_each_key_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 4, 2000, 30_000):
        d = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        f = CuckooFilter.of(d)
        assert f.has(d).all() and np.count_nonzero(f.slots) == n
        f.delete(d[: n // 2])
        assert f.has(d[n // 2 :]).all() and np.count_nonzero(f.slots) == n - n // 2
        assert f.insert(d[: n // 2]) and f.has(d).all()
    small = CuckooFilter(8)
    assert not small.insert(rng.integers(0, 1 << 63, (500, 2)).astype(np.uint64))


# --- op 8 -------------------------------------------------------------------------------
@pytest.mark.parametrize("held", [5000, 1])
def test_repeated_bytes_of_hot_anchors_and_another_parallelism(spark, monkeypatch, tmp_path, held):
    monkeypatch.setattr(substrings, "HELD", held)
    rng = random.Random(9)
    shared = prose(rng, 80)
    texts = [f"{prose(rng, rng.randint(0, 40))} {shared[: rng.randint(150, len(shared))]} {prose(rng, 30)}" for _ in range(25)] + ["ab" * 300, "abc" * 200, shared, shared, None]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    seen = []

    def other(df, tag, kept=False, f=substrings.save):
        seen.append(tag)
        spark.conf.set("spark.sql.files.minPartitionNum", str(1 + len(seen) % 7))
        return f(df, tag, kept)

    monkeypatch.setattr(substrings, "save", other)
    try:
        got = {r.doc_id: r for r in substrings.remove(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    for i, (n, removed, spans, kept) in enumerate(slow_removal(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (n, removed, spans, kept)


@pytest.mark.parametrize("width", [2, 7, 64, 200])
def test_full_doubling_against_brute_force(spark, width):
    rng = random.Random(width)
    shared = prose(rng, 60)
    texts = [f"{prose(rng, 5)} {shared[: rng.randint(100, 400)]}é {prose(rng, 5)}" for _ in range(8)] + ["ab" * 150, None, "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    data = [(t or "").encode() for t in texts]
    n = Counter(d[p : p + width] for d in data for p in range(len(d) - width + 1))
    want = {(i, p) for i, d in enumerate(data) for p in range(len(d) - width + 1) if n[d[p : p + width]] > 1}
    assert {(r.rid, r.place) for r in doubling.repeated(docs, width).collect()} == want


# --- op 9 -------------------------------------------------------------------------------
def test_short_items_sentence_names_marks_and_one_to_one_slots(spark):
    items = [(1, "What is Planck constant?"), (2, "Anna Smith has 12 apples and 30 pears, and her friend has 15 plums and 44 figs from the market."), (3, "42"), (4, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    swap = "Bob Jones has 21 apples and 31 pears, and her friend has 16 plums and 45 figs from the market."
    rows = [
        (1, "Tell me: what is Planck constant? Nobody knows."), (2, "what is the Planck constant"), (3, f"Start. {swap} End."),
        (4, "Bob Jones has 7 apples and 7 pears, and her friend has 7 plums and 7 figs from the market."), (5, "the number 42"),
        (6, f" {items[1][1]} "), (7, None), (8, ""),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 1), (3, 2), (6, 2)}
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {2, 4, 5, 7, 8}


def test_leaks_against_brute_force(spark):
    """Whole items among other words: every copy is found, nothing else."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "pra", "sti") for b in ("dor", "fen", "gal", "hix", "jup")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f"{sentence(rng.randint(6, 20))} {rng.randrange(100)} {sentence(6)}.") for k in range(20)]
    rows, want = [], set()
    for i in range(80):
        parts = [sentence(rng.randint(5, 40))]
        for k in rng.sample(range(20), rng.choice([0, 0, 1, 2])):
            parts += [items[k][1], sentence(10)]
            want.add((i, k))
        rows.append((i, " ".join(parts)))
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


# --- op 10 ------------------------------------------------------------------------------
@pytest.mark.parametrize(("every", "least"), [(30, 0.95), (20, 0.9), (15, 0.9)])
def test_fuzzy_passages_are_found(spark, tmp_path, every, least):
    """Passages of 90 words, each every-th word changed in one of two documents: the share of documents found."""
    rng = random.Random(every)
    rows = []
    for k in range(40):
        p = prose(rng, 90).split()
        q = [w if i % every != every - 1 else f"z{rng.randrange(10**6)}" for i, w in enumerate(p)]
        rows += [(2 * k, f"{prose(rng, 50)} {' '.join(p)} {prose(rng, 50)}"), (2 * k + 1, f"{prose(rng, 50)} {' '.join(q)} {prose(rng, 50)}")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    found = passages.shared_passages(spark.read.parquet(path)).count() / len(rows)
    print(f"one word in {every} changed: {found:.2f}")
    assert found >= least


def test_a_passage_of_many_documents_and_one_that_fits_only_a_later_one(spark, tmp_path):
    rng = random.Random(13)
    first, second = prose(rng, 40), prose(rng, 40)
    rows = [(0, f"{prose(rng, 20)} {first} {prose(rng, 20)}"), (1, f"{prose(rng, 20)} {second} {prose(rng, 20)}")]
    rows += [(k, f"{prose(rng, 20)} {first} {second} {prose(rng, 20)}") for k in range(2, 16)]
    rows += [(k, rows[5][1]) for k in (20, 21)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r for r in passages.shared_passages(spark.read.parquet(path)).collect()}
    # Half the passage is too short: the first two documents share nothing, the others all of it.
    assert set(got) == {*range(2, 16), 20, 21}
    assert {r.class_id for r in got.values()} == {2} and all(r.n_words >= 80 for r in got.values())
    # A link explains its places, so the members of a class are joined and not all linked with each other.
    assert got[5].n_copies == 2 and all(r.partner_id in got and r.partner_id != r.doc_id and r.n_links + r.n_copies >= 1 for r in got.values())


# --- op 1 -------------------------------------------------------------------------------
def test_fused_evidence_beats_the_text_alone(spark):
    rng = random.Random(14)
    lexicon = {"de": "der hund und die katze sind nicht hier das ist gut", "fr": "le chien et la chatte ne sont pas ici tout va bien", "es": "el perro y la gata no estan aqui todo va bien"}
    langs = sorted(lexicon)
    train = [(i, " ".join(rng.choices(lexicon[langs[i % 3]].split(), k=12)), langs[i % 3]) for i in range(90)]
    model = language.fit(spark.createDataFrame(train, "id long, text string, lang string"))
    rows = []
    for i in range(300):
        lang = langs[i % 3]
        text = " ".join(rng.choices(lexicon[lang].split(), k=rng.choice([0, 1, 1, 2])))
        declared = rng.choice([lang, lang, lang, None, rng.choice(langs)])
        rows.append((i, text, declared, f"h{i % 9}.site{i % 3}.{lang}", lang))
    asked = spark.createDataFrame(rows, "id long, text string, declared string, host string, truth string")
    got = {r.id: r for r in language.identify(asked, model).collect()}
    fused = np.mean([got[i].lang == lang for i, *_, lang in rows])
    alone = np.mean([got[i].text_lang == lang for i, *_, lang in rows])
    assert fused > 0.97 and fused > alone
