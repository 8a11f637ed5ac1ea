"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question asked again with
other figures or persons keeps its template.  Windows of template tokens are joined by hash
with those of the benchmark, and what they join is compared token by token.  A document that has most windows of an item
is a candidate; it counts if the values in its placeholders follow the item's consistently: one value of
the item stands for one value of the document, and the other way round.  Items too short for
windows count where they stand in a document whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import save, table, temporary

#: Tokens a window, and the share of an item's windows that a document must have.
WIDTH, SHARE = 5, 0.8
#: Most benchmark windows that are broadcast; a larger benchmark is joined by shuffled hashes.
HELD_WINDOWS = 2_000_000
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
_UNITS = "km|cm|mm|m|miles?|feet|ft|inch(?:es)?|kg|g|mg|lbs?|pounds?|tons?|litres?|liters?|l|ml|hours?|hrs?|h|minutes?|min|seconds?|sec|s|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|mph|kmh|watts?|kw|volts?"
#: What placeholders replace: a name, a unit after a digit, a number.  A name is a run of capitalised words, a sentence's first word among
#: them: it may be a name, and as a value it is compared all the same.  Scripts without case have no names.
#: Nothing follows a run, so it gives nothing back (``*+``): Java would take a frame of the stack for each part of a run that might.
_PLACES = rf"((?<![\p{{L}}\p{{N}}])\p{{Lu}}\p{{Ll}}+(?![\p{{L}}\p{{N}}])(?: \p{{Lu}}\p{{Ll}}+(?![\p{{L}}\p{{N}}]))*+)|((?<=\d ?)(?:{_UNITS})(?![\p{{L}}\p{{N}}]))|(\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*+)"
#: A value is written between the marks of its kind and this one, all in one pass, so that no search runs past a value.
_END = "\ue003"
_MARKED = rf" {NAME}$1{UNIT}$2{NUMBER}$3{_END} "
_TOKEN = rf"{NAME}[^{_END}]*{_END}|[\p{{L}}\p{{N}}]+"


def _plain(text: Column) -> Column:
    """The text without the marks that stand for placeholders here; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT + _END, "    ")


def raw_tokens(text: Column) -> Column:
    """The text's words and numbers as they are, lower case, each between spaces."""
    return F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(_plain(text)), r"[^\p{L}\p{N}]+"), lambda x: x != ""), " "), F.lit(" "))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(_plain(text), _PLACES, _MARKED), F.lit(_TOKEN), F.lit(0))


def template(text: Column) -> Column:
    """The template's tokens, lower case, placeholders in place of values."""
    kind = lambda x: F.when(~x.startswith(NAME), F.lower(x)).when(x.startswith(NAME + UNIT + NUMBER), NUMBER).when(x.startswith(NAME + UNIT), UNIT).otherwise(NAME)
    return F.transform(_tokens(text), kind)


def values(text: Column) -> Column:
    """For each token of ``template(text)`` the value its placeholder replaced, null for other tokens."""
    return F.transform(_tokens(text), lambda x: F.when(x.startswith(NAME), F.lower(F.translate(x, NUMBER + NAME + UNIT + _END, ""))))


def windows(tokens: Column) -> Column:
    """The hash of each window of five tokens, in order; fewer tokens have none.

    ``tokens`` must be a column of the input, not an expression: each window reads it five times.
    """
    each = F.transform(F.sequence(F.lit(0), F.size(tokens) - WIDTH), lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(WIDTH))))
    return F.when(F.size(tokens) >= WIDTH, each).otherwise(F.array().cast("array<bigint>"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def numbered(benchmark: DataFrame) -> DataFrame:
    """(i, item_id, text): each distinct row with a number of its own, as item_ids may be null or repeat."""
    return benchmark.select("item_id", "text").distinct().withColumn("i", F.monotonically_increasing_id())


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(i, window, of): each item's distinct windows with at least two plain tokens, and their number."""
    placed = items.select("i", template(F.col("text")).alias("t"))
    each = placed.select("i", "t", F.posexplode(windows(F.col("t"))).alias("at", "window"))
    plain = F.size(F.filter(F.slice("t", F.col("at") + 1, WIDTH), lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    own = each.where(plain >= 2).select("i", "window").distinct()
    return own.join(own.groupBy("i").agg(F.count("*").alias("of")), "i")


def _windows_as_text(tokens: Column) -> Column:
    return F.when(F.size(tokens) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(tokens) - WIDTH), lambda i: F.array_join(F.slice(tokens, i + 1, WIDTH), " "))).otherwise(F.array().cast("array<string>"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """(doc_id, text_key, item_id, n_windows, n_shared, n_slots, n_steady) of each leaking document and item.

    A document leaks an item if it has at least ``share`` of its windows, and at least
    ``share`` of the item's placeholder values stand for one value each in the document, and that for no other, or in one
    occurrence of the item in it.  Rows of one doc_id and text are one document; text_key is the text's hash.  Rows of the
    benchmark that differ in item_id or text are items by themselves, also without item_id; rows repeated whole are one.  Items without
    windows of two plain tokens are leaked where their words, two or more, stand in a document in a row; they have no
    windows and slots.  An item of one word, null or empty is no passage and matches nothing.  Very long texts are read
    whole; other columns are not read, whatever their names.  No documents or no items, no rows.
    """
    with temporary(docs.sparkSession):
        return save(_contaminated(docs, benchmark, share, held_windows), "contaminated", kept=True)


def _contaminated(docs: DataFrame, benchmark: DataFrame, share: float, held_windows: int) -> DataFrame:
    bench = save(numbered(benchmark), "bench-items")
    own = save(benchmark_windows(bench), "bench")
    small = own.count() <= held_windows
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df)  # checked: see HELD_WINDOWS
    placed = _keyed(docs).select("doc_id", "text_key", template(F.col("text")).alias("t"))
    each = placed.select("doc_id", "text_key", F.explode(windows(F.col("t"))).alias("window"))
    shared = each.join(held(own), "window").groupBy("doc_id", "text_key", "i", "of", "window").agg(F.lit(1).alias("one"))
    pairs = shared.groupBy("doc_id", "text_key", "i", "of").agg(F.count("*").alias("n")).where(F.col("n") >= share * F.col("of"))
    pairs = save(pairs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "i", "of"), "leaks-hashed")
    texts = save(_texts(docs, pairs), "leaks-texts")
    items = bench.select("i", template(F.col("text")).alias("ti"), values(F.col("text")).alias("vi"))
    items = save(items.join(pairs.select("i").distinct(), "i", "left_semi"), "leaks-items")
    pairs = save(_verified(pairs, texts, items).where(F.col("n_shared") >= share * F.col("of")), "leaks")
    slots = _slots(texts, items, pairs)
    p, s = pairs.alias("p"), slots.alias("s")
    out = p.join(s, F.expr("p.d <=> s.d AND p.k = s.k AND p.i = s.i"), "left").select("p.*", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_steady", F.lit(0)).alias("n_steady"))
    judged = save(out, "leaks-judged")
    ok = F.col("n_steady") >= share * F.col("n_slots")
    names = [F.col("d").alias("doc_id"), F.col("k").alias("text_key"), "i", F.col("of").alias("n_windows"), "n_shared", "n_slots", "n_steady"]
    crossed = judged.where(~ok).drop("n_slots", "n_steady")
    c, b = crossed.alias("c"), _occurrences(texts, items, crossed, share).alias("b")
    again = c.join(b, F.expr("c.d <=> b.d AND c.k = b.k AND c.i = b.i")).select("c.*", "b.n_slots", "b.n_steady")
    none = F.lit(0).cast("long")
    short = _short(docs, bench, own).select("doc_id", "text_key", "i", none.alias("n_windows"), none.alias("n_shared"), none.alias("n_slots"), none.alias("n_steady"))
    found = judged.where(ok).select(*names).union(again.select(*names)).union(short)
    return found.join(bench.select("i", "item_id"), "i").select("doc_id", "text_key", "item_id", "n_windows", "n_shared", "n_slots", "n_steady")


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(d, k, td, vd): template and values of the pairs' documents, each once."""
    keys = pairs.select("d", "k").distinct()
    keyed = _keyed(docs)
    texts = keyed.join(keys, keyed.doc_id.eqNullSafe(keys.d) & (keyed.text_key == keys.k)).dropDuplicates(["d", "k"])
    return texts.select("d", "k", template(F.col("text")).alias("td"), values(F.col("text")).alias("vd"))


def _met(pairs: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs`` with td, vd, ti, vi."""
    p, t = pairs.alias("p"), texts.alias("t")
    return p.join(t, F.expr("p.d <=> t.d AND p.k = t.k")).select("p.*", "td", "vd").join(items, "i")


def _verified(pairs: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs`` with n_shared: the item's distinct windows that the document has, compared as text."""
    tokens = F.transform(_windows_as_text(F.col("ti")), lambda w: F.when(F.size(F.filter(F.split(w, " "), lambda x: ~x.isin(NUMBER, NAME, UNIT))) >= 2, w))
    own = F.filter(tokens, lambda w: w.isNotNull())
    return _met(pairs, texts, items).select("d", "k", "i", "of", F.size(F.array_intersect(own, _windows_as_text(F.col("td")))).cast("long").alias("n_shared"))


def _short(docs: DataFrame, bench: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, text_key, i) of items without windows, two words at least, that stand in a document whole.

    Joined by the hash of their first two words, then compared as text.
    """
    rest = bench.join(own.select("i").distinct(), "i", "left_anti").select("i", raw_tokens(F.col("text")).alias("words"))
    first = lambda words: F.xxhash64(F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    rest = rest.withColumn("w", F.split(F.trim("words"), " ")).where(F.size("w") >= 2).select("i", "words", first(F.col("w")).alias("pair"))
    rest = save(rest, "bench-short")
    if rest.isEmpty():
        return rest.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("text_key"), "i")
    texts = _keyed(docs).select("doc_id", "text_key", raw_tokens(F.col("text")).alias("theirs")).withColumn("w", F.split(F.trim("theirs"), " "))
    pairs = F.when(F.size("w") >= 2, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1))))).otherwise(F.array().cast("array<bigint>"))
    small = rest.limit(HELD_WINDOWS + 1).count() <= HELD_WINDOWS
    held = F.broadcast(rest) if small else rest  # checked: see HELD_WINDOWS
    met = texts.select("doc_id", "text_key", "theirs", F.explode(pairs).alias("pair")).join(held, "pair")
    return met.where(F.contains("theirs", "words")).select("doc_id", "text_key", "i").distinct()


def _steady(each: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_slots, n_steady): an item's values, and those that stand for one value of the document that stands for no other."""
    each = each.select(*keys, "mine", "theirs").distinct()
    back = each.groupBy(*keys, "theirs").agg(F.count("*").alias("of_theirs"), F.collect_set("mine").alias("all"))
    one = back.select(*keys, F.explode("all").alias("mine"), "of_theirs").groupBy(*keys, "mine").agg(F.count("*").alias("n"), F.max("of_theirs").alias("m"))
    return one.groupBy(*keys).agg(F.count("*").alias("n_slots"), F.count_if((F.col("n") == 1) & (F.col("m") == 1)).alias("n_steady"))


def _occurrences(texts: DataFrame, items: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """(d, k, i, n_slots, n_steady): of pairs with an occurrence of the item that is consistent by itself, its best.

    An occurrence is an offset of the item in the document at which at least ``share`` of the item's windows are found;
    its slots are compared place by place, so that equal windows elsewhere are not crossed.
    """
    mine = items.join(pairs.select("i").distinct(), "i", "left_semi").select("i", "ti", F.posexplode(_windows_as_text(F.col("ti"))).alias("q", "window"))
    plain = F.size(F.filter(F.slice("ti", F.col("q") + 1, WIDTH), lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    p, t = pairs.select("d", "k").distinct().alias("p"), texts.alias("t")
    theirs = p.join(t, F.expr("p.d <=> t.d AND p.k = t.k")).select("p.d", "p.k", F.posexplode(_windows_as_text(F.col("td"))).alias("p", "window"))
    met = theirs.join(mine.where(plain >= 2).select("i", "q", "window"), "window").select("d", "k", "i", "window", (F.col("p") - F.col("q")).alias("at"))
    places = met.distinct().groupBy("d", "k", "i", "at").agg(F.count("*").alias("n"))
    w, o = pairs.alias("w"), places.alias("o")
    found = save(w.join(o, F.expr("w.d <=> o.d AND w.k = o.k AND w.i = o.i")).where(F.col("o.n") >= share * F.col("w.of")).select("w.d", "w.k", "w.i", "o.at"), "leaks-places")
    # Values are rows that are joined by their places: no array goes along with an offset.
    held = lambda df, t, v, *keys: df.select(*keys, F.posexplode(F.arrays_zip(F.col(t).alias("t"), F.col(v).alias("v"))).alias("place", "z")).where("z.v IS NOT NULL").select(*keys, "place", "z.t", "z.v")
    wanted = found.join(held(items, "ti", "vi", "i"), "i").select("d", "k", "i", "at", (F.col("at") + F.col("place")).alias("place"), "t", F.col("v").alias("mine")).alias("w")
    some = found.select("d", "k").distinct().alias("p")
    others = some.join(t, F.expr("p.d <=> t.d AND p.k = t.k")).select("p.d", "p.k", "td", "vd")
    others = held(others, "td", "vd", "d", "k").withColumnRenamed("v", "theirs").alias("o")
    slots = wanted.join(others, F.expr("w.d <=> o.d AND w.k = o.k AND w.place = o.place AND w.t = o.t")).select("w.d", "w.k", "w.i", "w.at", "w.mine", "o.theirs")
    one = _steady(slots, "d", "k", "i", "at").where(F.col("n_steady") >= share * F.col("n_slots"))
    best = one.groupBy("d", "k", "i").agg(F.max(F.struct(F.col("n_steady"), -F.col("at"), F.col("n_slots"))).alias("b"))
    return best.select("d", "k", "i", F.col("b.n_slots").alias("n_slots"), F.col("b.n_steady").alias("n_steady"))


def _placed(df: DataFrame, t: str, v: str, *keys: str) -> DataFrame:
    """(keys, window, slots): each distinct window that has placeholders, with their values in order."""
    each = df.where(F.exists(v, lambda x: x.isNotNull())).select(*keys, v, F.posexplode(_windows_as_text(F.col(t))).alias("at", "window"))
    slots = F.filter(F.slice(v, F.col("at") + 1, WIDTH), lambda x: x.isNotNull())
    return each.select(*keys, "window", slots.alias("slots")).where(F.size("slots") > 0).distinct()


def _slots(texts: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(d, k, i, n_slots, n_steady): the item's values that candidates' windows align, and those with one counterpart."""
    mine = _placed(items, "ti", "vi", "i")
    theirs = _placed(texts, "td", "vd", "d", "k").withColumnRenamed("slots", "other").alias("t")
    wanted = pairs.select("d", "k", "i").join(mine, "i").alias("w")
    met = wanted.join(theirs, F.expr("w.d <=> t.d AND w.k = t.k AND w.window = t.window")).select("w.d", "w.k", "w.i", F.explode(F.arrays_zip("slots", "other")).alias("z"))
    return _steady(met.select("d", "k", "i", F.col("z.slots").alias("mine"), F.col("z.other").alias("theirs")), "d", "k", "i")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns; rows with null doc_id or text are judged like others, repeated ones alike."""
    bad = save(contaminated(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct(), "leaking")
    d, b = docs.alias("d"), bad.alias("b")
    return d.join(b, F.col("d.doc_id").eqNullSafe(F.col("b._d")) & (F.xxhash64(F.col("d.text")) == F.col("b._k")), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_windows, n_shared, n_slots, n_steady) of each leaking document and item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
