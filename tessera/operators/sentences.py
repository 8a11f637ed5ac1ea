"""Sentences by what the corpus itself tells: abbreviations and sentence starters from log-likelihoods, without a word list.

A type that nearly always ends with a period, is short, and has periods inside, is an abbreviation; a type that follows
sentence ends much more often than chance is a starter (Kiss and Strunk, 2006).  Both are counted by grouping over all texts.  A
period ends a sentence unless an abbreviation carries it or the next word is in lower case; one of an abbreviation does
where a capitalised starter follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import keep

#: Least scores, and the share of periods that an abbreviation is expected to have.
ABBREVIATION, STARTER, EXPECTED = 0.3, 30.0, 0.99
#: Most learned types that are broadcast with their texts; more are joined by type.
HELD_TYPES = 20_000
_CLOSING = r"[\)\]\}\"'’”»]*$"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def bare(token: Column) -> Column:
    """The token in lower case, without other characters before and after than letters, digits and final periods."""
    return F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")


def kind(token: Column) -> Column:
    """The token's type: without final periods."""
    return F.regexp_replace(bare(token), r"\.+$", "")


def _token_counts(texts: DataFrame) -> DataFrame:
    """(token, n): tokens as they stand, so that what follows is done once for each distinct one."""
    return texts.select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _end_pairs(texts: DataFrame) -> DataFrame:
    """(token, next, n) of tokens that may end a sentence."""
    w = texts.select(words(F.col("text")).alias("w"))
    some = F.filter(F.transform("w", lambda x, i: F.when(x.rlike("[.!?]"), F.struct(x.alias("token"), F.get("w", i + 1).alias("next")))), lambda p: p.isNotNull())
    return w.select(F.explode(some).alias("p")).groupBy("p.token", "p.next").agg(F.count("*").alias("n"))


def _ends(token: Column) -> Column:
    return token.rlike(r"[.!?]" + _CLOSING)


def type_counts(texts: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(type, with_period, without): how often each type ends with one period and how often not."""
    each = (_token_counts(texts) if counted is None else counted).select(bare(F.col("token")).alias("b"), "n")
    dot = F.col("b").rlike(r"(^|[^.])\.$")  # an ellipsis says nothing
    some = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    return each.groupBy(F.regexp_replace("b", r"\.+$", "").alias("type")).agg(some(dot).alias("with_period"), some(~dot).alias("without"))


def abbreviations(texts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(type, with_period, without, score) of the abbreviations among the texts' types."""
    counted = keep(type_counts(texts), "sentence-types") if counts is None else counts
    sums = counted.agg(F.sum("with_period").alias("dots"), F.sum(F.col("with_period") + F.col("without")).alias("all"))
    some = counted.where(F.col("type").rlike(r"\p{L}") & ~F.col("type").rlike(r"\p{N}") & (F.col("with_period") > 0))
    p, k, m = F.col("dots") / F.col("all"), F.col("with_period"), F.col("without")
    rest = F.greatest(F.lit(1.0) - p, F.lit(1e-12))  # a corpus of periods alone
    likelihood = F.lit(-2.0) * (k * F.log(p) + m * F.log(rest) - k * F.log(F.lit(EXPECTED)) - m * F.log(F.lit(1.0 - EXPECTED)))
    inner = F.length(F.regexp_replace("type", r"[^.]", ""))
    plain = F.length("type") - inner
    score = likelihood * F.exp(-plain.cast("double")) * (inner + 1) * F.pow(plain.cast("double"), -m.cast("double"))
    return some.crossJoin(F.broadcast(sums)).withColumn("score", score).where(F.col("score") >= ABBREVIATION).select("type", "with_period", "without", "score")  # one row of sums


def starters(texts: DataFrame, known: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(type, at_start, total, score) of the types that follow sentence ends, but for ends that ``known`` abbreviations carry, more often than chance."""
    counts = keep(type_counts(texts), "sentence-types") if counts is None else counts
    total = counts.select("type", (F.col("with_period") + F.col("without")).alias("total"))
    ends = _end_pairs(texts).where(_ends(F.col("token"))).groupBy(kind(F.col("token")).alias("type"), bare(F.col("token")).alias("end"), kind(F.col("next")).alias("after")).agg(F.sum("n").alias("n"))
    carried = known.select("type", F.lit(True).alias("known"))
    ends = keep(ends.join(carried, "type", "left").where(F.col("known").isNull() | ~F.col("end").endswith(".")).select("after", "n"), "sentence-ends")
    sums = total.agg(F.sum("total").alias("all")).crossJoin(ends.agg(F.sum("n").alias("breaks")))
    first = ends.where(F.col("after").rlike(r"\p{L}")).groupBy(F.col("after").alias("type")).agg(F.sum("n").alias("at_start"))
    a, b, ab, n = F.col("breaks").cast("double"), F.col("total").cast("double"), F.col("at_start").cast("double"), F.col("all").cast("double")

    def log_l(k: Column, of: Column, p: Column) -> Column:
        """log of p^k (1 - p)^(of - k); nothing where a factor is 1."""
        part = lambda m, q: F.when(m > 0, m * F.log(q)).otherwise(0.0)
        return part(k, p) + part(of - k, F.lit(1.0) - p)

    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    score = F.lit(-2.0) * (log_l(ab, a, p) + log_l(b - ab, n - a, p) - log_l(ab, a, p1) - log_l(b - ab, n - a, p2))
    met = first.join(total, "type").crossJoin(F.broadcast(sums)).where((ab <= b) & (n > a) & (n * ab > a * b))  # one row of sums
    return met.withColumn("score", score).where(F.col("score") >= STARTER).select("type", "at_start", "total", "score")


@dataclass(frozen=True)
class Splitter:
    """``known``: abbreviations, ``first``: starters."""

    known: DataFrame
    first: DataFrame

    @classmethod
    def learn(cls, texts: DataFrame) -> Splitter:
        counts = keep(type_counts(texts), "sentence-types")
        known = keep(abbreviations(texts, counts), "abbreviations")
        return cls(known, keep(starters(texts, known, counts), "starters"))

    def split(self, texts: DataFrame, key: str) -> DataFrame:
        """(key, idx, sentence) of ``texts`` (key, text), each sentence's words joined by one space; texts without words have none."""
        w = texts.select(key, words(F.col("text")).alias("w")).where(F.size("w") > 0)
        # Only a token with a period is looked up among abbreviations, and only the one after it among starters.
        asked = F.array_distinct(F.flatten(F.transform(F.filter(F.transform("w", lambda x, i: F.when(F.contains(x, F.lit(".")), F.array(x, F.coalesce(F.get("w", i + 1), x)))), lambda p: p.isNotNull()), lambda p: F.transform(p, kind))))
        types = lambda df: df.select("type")
        if all(df.limit(HELD_TYPES + 1).count() <= HELD_TYPES for df in (self.known, self.first)):
            one = lambda df, name: F.broadcast(types(df).agg(F.collect_list("type").alias(name)))
            met = w.crossJoin(one(self.known, "k")).crossJoin(one(self.first, "f"))  # one row each
            met = met.select(key, "w", F.array_intersect(asked, "k").alias("k"), F.array_intersect(asked, "f").alias("f"))
        else:
            w = keep(w.withColumn("_r", F.monotonically_increasing_id()), "sentence-words")
            each = w.select("_r", F.explode(asked).alias("type"))
            own = lambda df, name: each.join(types(df), "type").groupBy("_r").agg(F.collect_set("type").alias(name))
            met = w.join(own(self.known, "k"), "_r", "left").join(own(self.first, "f"), "_r", "left")
            none = F.array().cast("array<string>")
            met = met.select(key, "w", F.coalesce("k", none).alias("k"), F.coalesce("f", none).alias("f"))
        # Few tokens may end a sentence: the rules are applied to those, and sentences are slices between them.
        some = F.filter(F.transform("w", lambda x, i: F.when(x.rlike("[.!?]"), F.struct(i.alias("i"), x.alias("token"), F.get("w", i + 1).alias("next")))), lambda p: p.isNotNull() & p["next"].isNotNull())
        # ``held`` binds a text's own types: as plain columns Spark would find them anew for each token.
        held = F.array(F.struct(F.col("k"), F.col("f")))
        breaks = F.flatten(F.transform(held, lambda h: F.filter(some, lambda p: self._break(p["token"], p["next"], h["k"], h["f"]))))
        inner = F.transform(breaks, lambda p: p["i"] + 1)
        cut = met.select(key, "w", F.array_append(inner, F.size("w")).alias("e"))
        start = lambda k: F.when(k == 0, 0).otherwise(F.get("e", k - 1))
        parts = F.transform("e", lambda e, k: F.array_join(F.slice("w", start(k) + 1, e - start(k)), " "))
        return cut.select(key, F.posexplode(parts).alias("idx", "sentence"))

    @staticmethod
    def _break(token: Column, after: Column, k: Column, f: Column) -> Column:
        lower, upper = after.rlike(r"^[^\p{L}\p{N}]*\p{Ll}"), after.rlike(r"^[^\p{L}\p{N}]*\p{Lu}")
        period = token.rlike(r"\." + _CLOSING)
        carried = period & (F.array_contains(k, kind(token)) | token.rlike(r"^[^\p{L}\p{N}]*\p{L}\." + _CLOSING))
        return F.when(~_ends(token) | lower, False).when(carried, upper & F.array_contains(f, kind(after))).when(period & token.rlike(r"\.\."), upper).otherwise(True)
