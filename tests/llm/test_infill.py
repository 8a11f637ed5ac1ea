"""Fill-in-the-middle against a version that cuts one text at a time, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(doc_id, text, seed=42, rate=50, spm_rate=80):
    t = text or ""
    units = TOKEN.findall(t)
    assert "".join(units) == t
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\n\t", "a", " a", "a ", "  a  b  ", "<", "a <P> b", "x<S>", "<M>", "<P", "S> <", "é", " 日本 語　x ", "\x1c\x85\xa0 b", "ab\x00c d", "🦆 🦆\r\n🦆"]
    out += ["".join(rng.choice("ab <>PSMé日🦆\n\t") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    return out + ["word " * 400_000, "x" * 1_500_000, " " * 300_000]


@pytest.mark.parametrize("piece", [1 << 22, 64])
def test_texts_are_cut_as_one_by_one(spark, texts, piece, monkeypatch):
    monkeypatch.setattr(infill, "SLICE", piece)
    rows = [(i * 7 - 50, t, "h") for i, t in enumerate(texts)] + [(None, "one two three four", "h"), (7, "same here", "h"), (7, "same here", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(2)
    out = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.back, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out.collect())
    assert got == sorted(((i is None, i or 0), t or "", slow(i, t)) for i, t, _ in rows)
    assert {g[2][1] for g in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).collect() == []


def test_cuts_of_empty_batches():
    n, first, second = infill.cuts(np.empty(0, np.uint8), np.zeros(3, np.int64), np.ones((2, 2), np.uint64))
    assert n.tolist() == first.tolist() == second.tolist() == [0, 0]
