"""Scalar expressions: tokens, rounding, similarity, keys, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(x: Column, digits: int) -> Column:
    """Round half up on the double itself, the same in any engine."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)).cast("double") / F.lit(10.0**digits)


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of two characters or more, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def token_count(text: Column) -> Column:
    """Words between white space: the default counter."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\. "), lambda s: F.trim(s)), lambda s: s != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0.0, 0.0).otherwise(dot(a, b) / norms)


def chunk_id(source: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, index.cast("string")), 256), 1, 12)


def cache_key(query: Column, prefix: str = "cache:") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.lower(F.trim(query)), 256), 1, 12))


def doc_key(filename: Column, at: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", filename, at), 256), 1, 16)


def preview(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def strip_fence(text: Column) -> Column:
    """The inside of a Markdown code fence, or the text itself, trimmed."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[a-zA-Z]*\s*\n?(.*?)\n?\s*```\s*$", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def parse_score(raw: Column) -> Column:
    """A critic's score: the number after a score key within the first flat object that has one, else the score of valid
    JSON, or, where there is no valid JSON, the first number 0.x; clamped to 0..1, null if nothing is found.

    Objects are what stands between an opening brace and the next closing one; of an object's score keys the last number counts.
    """
    closed = F.slice(F.split(raw, "[}]"), 1, F.greatest(F.size(F.split(raw, "[}]")) - 1, F.lit(0)))
    inside = F.transform(F.filter(closed, lambda x: F.contains(x, F.lit("{"))), lambda x: F.substr(x, F.instr(x, F.lit("{"))))
    numbers = F.transform(inside, lambda x: F.filter(F.transform(F.split(x, '"score"'), lambda y, k: F.when(k > 0, F.regexp_extract(y, "^\\s*:\\s*([0-9.]+)", 1)).otherwise("")), lambda n: n != ""))
    first = F.get(F.filter(numbers, lambda n: F.size(n) > 0), F.lit(0))
    stated = F.get(first, F.size(first) - 1).try_cast("double")
    fraction = F.nullif(F.regexp_extract(raw, "0[.][0-9]+", 0), F.lit("")).try_cast("double")
    is_json = F.try_parse_json(raw).isNotNull() & (F.trim(raw) != "")
    value = F.coalesce(stated, F.when(is_json, F.get_json_object(raw, "$.score").try_cast("double")).otherwise(fraction))
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def keyword_hit_rate(keywords: Column, answer: Column) -> Column:
    """Share of keywords that are case-insensitive substrings; 0 if either is empty."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when((F.size(keywords) <= 0) | (F.coalesce(answer, F.lit("")) == ""), 0.0).otherwise(hits / F.size(keywords))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^.]+)$", 1))


def mean_or_zero(x: Column, digits: int = 4) -> Column:
    return F.coalesce(exact_round(F.avg(x), digits), F.lit(0.0))
