"""Language identification by Bayesian evidence fusion.

Multiplied are the text's likelihood under character n-gram models, the likelihood of the language that its markup
declares, and a prior for its address.  Priors are smoothed in steps, all rows to the address's suffix to its domain to
its host, from grouped counts of what the texts alone say; each count enters once, a host that is its own domain or
suffix is no step of its own, and a row's own vote is left out of every step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import save, table

#: Most labelled rows that the text models are fitted on, those of smallest hashed id.
SAMPLE_ROWS = 4000
#: n-grams of a text count as independent up to this number: beyond it a text is not more certain.
INDEPENDENT = 60.0
#: Weight of the wider level's prior, in rows.
SMOOTH = 5.0
#: Words are runs of letters, in training (by Spark) as in scoring.
_words = regex.compile(r"\p{L}+").findall


def word_grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


class TextModel:
    """Log-likelihoods of character trigrams by language, added up by word and memoised."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray], unseen: np.ndarray) -> None:
        self.languages, self.grams, self.unseen = languages, grams, unseen
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(languages) + 1))

    def _add(self, word: str) -> int:
        if len(self.place) >= 400_000:
            self.place.clear()
        k = self.place[word] = len(self.place)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        grams = word_grams(word)
        self.rows[k, :-1] = sum(self.grams.get(g, self.unseen) for g in grams)
        self.rows[k, -1] = len(grams)
        return k

    def score(self, text: str | None) -> list[float]:
        """The log-likelihood by language, of at most INDEPENDENT n-grams' weight; zeros without letters."""
        words, total, place = _words((text or "").lower()), np.zeros(len(self.languages) + 1), self.place
        for s in range(0, len(words), 4096):
            part = words[s : s + 4096]
            if len(place) + len(part) >= 400_000:
                place.clear()
            at = [k if (k := place.get(w)) is not None else self._add(w) for w in part]
            total += self.rows[at].sum(0)
        n = total[-1]
        return (total[:-1] * (min(n, INDEPENDENT) / n)).tolist() if n else [0.0] * len(self.languages)


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, least: int = 3) -> TextModel:
    """``labelled``: id, text, lang.  Counts trigrams of the sample by language on the executors; what
    reaches the driver is bounded by the sample's distinct trigrams."""
    # Ids are chosen first, so that only the sample's texts move; it bounds the broadcast.
    ids = labelled.where(F.col("lang").isNotNull()).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = labelled.where(F.col("lang").isNotNull()).join(F.broadcast(ids), "id")
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "w", F.lit(" "))
    grams = words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))).alias("g"))
    counts = grams.groupBy("g", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return TextModel(["und"], {}, np.zeros(1))
    wide = counts.pivot(index="g", columns="lang", values="n").reindex(columns=languages).fillna(0.0)
    total = wide.to_numpy().sum(0) + 0.5 * (len(wide) + 1)
    return TextModel(languages, dict(zip(wide.index, np.log((wide.to_numpy() + 0.5) / total), strict=True)), np.log(0.5 / total))


def text_scores(model: TextModel, text: Column) -> Column:
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="object")

    return run(text)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def declared_of(html: Column) -> Column:
    """The primary language of the html element's lang attribute, null without one."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def text_of(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"&[a-zA-Z]+;|&#\d+;", " ")


#: The steps of the prior, from the widest.
_LEVELS = ("suffix", "domain", "host")


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows``: id, text, declared, host (the last two may be null).  Returns id, lang, confidence, text_lang.

    One row out for each row in, repeated ids too; of equally likely languages the first by name.  Without letters, the text
    says nothing and the other evidence decides; without any evidence the commonest language is given.  Null and empty
    texts, hosts and declarations are no evidence, very long texts are read whole, other columns are not read.  No rows, no rows.
    """
    langs = model.languages
    k = len(langs)
    name = F.nullif(F.coalesce("host", F.lit("")), F.lit(""))
    part = lambda pattern: F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), pattern, 1), F.lit(""))
    suffix, domain = part(r"\.([a-z]+)$"), part(r"([^.]+\.[^.]+)$")
    scored = rows.select("id", "declared", suffix.alias("suffix"), domain.alias("domain"), F.when(~name.eqNullSafe(domain), name).alias("host"), text_scores(model, F.col("text")).alias("s"))
    scored = scored.withColumn("vote", F.array_position("s", F.array_max("s")).cast("int")).withColumn("heard", F.array_max("s") < 0)
    scored = save(scored, "lang-text")
    votes = [F.sum(F.when((F.col("vote") == i + 1) & F.col("heard"), 1.0).otherwise(0.0)) for i in range(k)]
    arr = lambda name: F.array(*votes).alias(name)
    # One row for all rows.
    total = scored.agg(arr("all_n"), F.sum(F.when(F.col("declared").isin(langs) & F.col("heard"), 1.0).otherwise(0.0)).alias("said"), F.sum(F.when(F.col("declared").isin(langs) & F.col("heard") & (F.element_at(F.array(*map(F.lit, langs)), F.col("vote")) == F.col("declared")), 1.0).otherwise(0.0)).alias("agreed")).first()
    heard = [x or 0.0 for x in total.all_n]
    prior = [(x + 1.0) / (sum(heard) + k) for x in heard]
    trust = ((total.agreed or 0.0) + 9.0) / ((total.said or 0.0) + 10.0)
    joined = scored
    for level in _LEVELS:
        counts = save(scored.where(F.col(level).isNotNull()).groupBy(level).agg(arr(f"{level}_n")), f"lang-{level}")
        joined = joined.join(counts, level, "left")

    def step(counts: str, i: int, wider: Column) -> Column:
        own = F.when(F.col("heard") & (F.col("vote") == i + 1), 1.0).otherwise(0.0)
        any_own = F.when(F.col("heard"), 1.0).otherwise(0.0)
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) - any_own
        return F.when(F.col(counts).isNull(), wider).otherwise((F.get(counts, F.lit(i)) - own + SMOOTH * wider) / (n + SMOOTH))

    posts = []
    for i, lang in enumerate(langs):
        address = F.lit(prior[i])
        for level in _LEVELS:
            address = step(f"{level}_n", i, address)
        said = F.when(~F.col("declared").isin(langs) | F.col("declared").isNull(), 0.0).when(F.col("declared") == lang, math.log(trust)).otherwise(math.log((1 - trust) / max(1, k - 1)))
        posts.append(F.get("s", F.lit(i)) + said + F.log(address))
    out = joined.select("id", "s", "vote", "heard", F.array(*posts).alias("p")).withColumn("best", F.array_max("p"))
    names = F.array(*map(F.lit, langs))
    mass = F.aggregate("p", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return out.select("id", F.element_at(names, F.array_position("p", F.col("best")).cast("int")).alias("lang"), (1.0 / mass).alias("confidence"), F.when(F.col("heard"), F.element_at(names, F.col("vote"))).alias("text_lang"))


def training_rows(docs: DataFrame) -> DataFrame:
    """The labelled documents outside the held-out fifth."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select(F.col("doc_id").alias("id"), "text", "lang")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its text, and its source as host (documents have no markup and no address)."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lower("source").alias("host"))
    return identify(rows, fit(training_rows(docs))).withColumnRenamed("id", "doc_id")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, from its visible text, declared language, address suffix and host."""
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").alias("id"), text_of(F.col("html")).alias("text"), declared_of(F.col("html")).alias("declared"), F.nullif(host_of(F.col("url")), F.lit("")).alias("host"))
    return identify(rows, fit(training_rows(table(spark, sf_dir, "documents")))).withColumnRenamed("id", "page_id")
