"""Leaks whose template windows stand at several places."""

from pyspark.sql import functions as F

from tessera.llm import decontaminate


def test_repeated_windows_are_compared_by_place(spark):
    numbers = "Please sort the numbers 2, 4, 6, 8, 10, 12, 14 from the largest down to the smallest of them all."
    tale = "Yesterday the trader Anna Smith bought 12 apples and 30 pears for 5.50 dollars at the market, then Anna Smith sold 12 apples to the neighbour."
    first = tale.replace("Anna Smith", "Bob Jones").replace("12", "99").replace("30", "31")
    second = tale.replace("Anna Smith", "Carl Hill").replace("12", "77").replace("30", "32")
    mixed = "Yesterday the trader Bob Jones bought 99 apples and 31 pears for 7 euros at the market, then Carl Hill sold 98 apples to the neighbour."
    items = spark.createDataFrame([(1, numbers), (2, tale)], "item_id long, text string")
    rows = [(1, f"before. {numbers} after"), (2, f"{first} And so on. {second}"), (3, f"{tale} Then 1, 2, 3, 4, 5, 6, 7, 8, 9. {second}"), (4, mixed), (None, numbers), (5, "nothing here of it all, really")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (None, 1)}
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {4, 5}


def test_items_are_rows(spark):
    """Equal and missing item_ids: each text is found by itself; a row repeated whole is one item."""
    one = "When the seventh trader counts 12 barrels of oil, how many barrels remain after selling three of them?"
    two = "Which of the northern harbours froze in 1740 and for how many weeks did the ice then hold?"
    short = "quiet yellow"
    items = spark.createDataFrame([(7, one), (7, two), (7, one), (None, two), (None, short)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {one} b"), (2, f"c {two} d"), (3, "a quiet yellow door")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 7), (2, 0), (2, 7), (3, 0)]


def test_placeholders_are_marked_in_one_pass(spark):
    text = "Anna Smith ran 5km and 12.5 miles, x5km h2o; 3/4 m of Bob's 7 kg5 10,000.5 £ ÉTÉ Été ½ l"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(decontaminate.template(F.col("t")).alias("t"), decontaminate.values(F.col("t")).alias("v")).collect()
    n, a, u = decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT
    assert got[0].t == [a, "ran", n, u, "and", n, u, "x", n, u, "h", n, "o", n, u, "of", a, "s", n, "kg", n, n, "été", a, "½", "l"]
    assert [v for v in got[0].v if v] == ["anna smith", "5", "km", "12.5", "miles", "5", "km", "2", "3/4", "m", "bob", "7", "5", "10,000.5", "été"]
    assert len(got[0].v) == len(got[0].t) and got[1].t == got[2].t == []


def test_very_long_runs_of_names_and_numbers(spark):
    """Each run is one value, however long: a search that takes stack for each part of it ended the executor."""
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    runs = ["Alice " * 20_000, "1." * 20_000, "Bob 1:2 " * 20_000]
    docs = spark.createDataFrame([(k, f"{run}so {item}") for k, run in enumerate(runs)] + [(9, runs[0])], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(docs, items).collect()) == [0, 1, 2]
    kinds = docs.where("doc_id < 2").orderBy("doc_id").select(F.slice(decontaminate.template(F.col("text")), 1, 2).alias("t")).collect()
    assert [r.t for r in kinds] == [[decontaminate.NAME, "so"], [decontaminate.NUMBER, "so"]]
