"""Learned sentence ends on a labelled sample, against the plain rule."""

import pytest

from tessera.functions.scalar import sentences as plain
from tessera.operators import sentences
from tessera.operators.sentences import Splitter

NAMES = ["Smith", "Jones", "Miller", "Brown", "Clark", "Lewis", "Young", "Hall", "Allen", "King"]
#: Sentences with abbreviations inside and at their ends.
MADE = [
    ["The office of Dr. {a} opens at nine."],
    ["We met Prof. {a} and Mr. {b} near the river.", "It was late!"],
    ["They sell paper, ink, etc. at the corner.", "The shop is small."],
    ["See vol. 3 of the works of {a}.", "The print is old."],
    ["Did Mrs. {b} call?", "She did so twice."],
    ["He lives in the U.S. now.", "The house of J. {a} is empty."],
    ["The train left at 5 p.m. on Sunday.", "It came back at 7 a.m. the day after."],
    ["Tools, nails, etc. were sold to Mr. {a}.", "The rest was kept."],
    ["The {b} family paid approx. 40 coins.", "It was enough..."],
]
#: Words that end sentences stand within others too.
FILLER = ["By nine on Sunday and after a late call the small river at the old corner was so empty that now the day kept coins enough for {a} and {b} to call.", "The day they kept nine coins the old river was small, and twice {a} saw how late the day was."]


@pytest.fixture(scope="module")
def sample():
    out = []
    for i in range(400):
        a, b = NAMES[i % 10], NAMES[i * 7 % 10]
        out.append((i, [x.format(a=a, b=b) for x in [*MADE[i % len(MADE)], FILLER[i % 2], *MADE[i * 5 % len(MADE)]]]))
    return out


@pytest.mark.parametrize("held", [20_000, 0])
def test_learned_ends_are_better_than_the_plain_rule(spark, sample, held, monkeypatch):
    monkeypatch.setattr(sentences, "HELD_TYPES", held)
    texts = spark.createDataFrame([(i, " ".join(s)) for i, s in sample], "id int, text string")
    split = Splitter.learn(texts)
    known = {r.type for r in split.known.collect()}
    assert {"dr", "mr", "etc", "p.m"} <= known and not {"river", "empty", "small", "corner"} & known
    got: dict[int, list] = {}
    for r in split.split(texts, "id").orderBy("id", "idx").collect():
        got.setdefault(r.id, []).append(r.sentence)
    base = {r.id: r.s for r in texts.select("id", plain(texts["text"]).alias("s")).collect()}
    right = sum(got[i] == s for i, s in sample)
    by_rule = sum([x.rstrip(".") for x in base[i]] == [x.rstrip(".") for x in s] for i, s in sample)
    print(f"texts split right: {right} of {len(sample)}, by the plain rule {by_rule}")
    assert right >= 0.95 * len(sample) and by_rule < 0.5 * len(sample)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "no end"), (5, "One. two. Three? \"Four!\" Five"), (6, "...")]
    texts = spark.createDataFrame(rows, "id int, text string")
    got = {(r.id, r.idx): r.sentence for r in Splitter.learn(texts).split(texts, "id").collect()}
    assert got == {(4, 0): "no end", (5, 0): "One. two.", (5, 1): "Three?", (5, 2): "\"Four!\"", (5, 3): "Five", (6, 0): "..."}
    assert Splitter.learn(texts.limit(0)).split(texts.limit(0), "id").collect() == []


def test_tokens_are_judged_once_each(spark):
    """Types are told from distinct tokens and the ends from distinct pairs: rules do not run at every place of a word."""
    texts = spark.createDataFrame([(i, "Mr. Hall came. The dog saw Mr. Hall again today.") for i in range(50)], "id int, text string")
    assert sentences._token_counts(texts).count() == 8
    pairs = {(r.token, r.next): r.n for r in sentences._end_pairs(texts).collect()}
    assert pairs == {("Mr.", "Hall"): 100, ("came.", "The"): 50, ("today.", None): 50}
    counts = {r.type: (r.with_period, r["without"]) for r in sentences.type_counts(texts).collect()}
    assert counts["mr"] == (100, 0) and counts["hall"] == (0, 100) and counts["today"] == (50, 0)
