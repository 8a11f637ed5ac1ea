"""Source divergence audit: how far the sources of a language differ in the terms they use, and by which terms.

Terms are counted within the tasks, then by group of language and source.  A language's kept terms are numbered in chunks;
a group's counts of a chunk are a packed vector.  Groups are dealt in blocks, and the vectors are replicated to the
tiles of two blocks: a tile takes the chunks of one stretch of the vocabulary one after another and adds up the submatrix
of its pairs.  Terms that no group of a tile has are not visited: all their summands are one value, which is multiplied.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import save, table, temporary

LEAST, TOP = 10, 10
SCALE = 1_000_000_000
#: Terms a chunk, chunks a stretch of the vocabulary, groups a block.
CHUNK, STRETCH, BLOCK = 4096, 16, 16
#: Terms that a task counts before it hands them on, and languages whose sizes are broadcast.
FLUSH, HELD_LANGS = 300_000, 100_000
#: Letters of ASCII in lower case, all bytes of other code points; anything else separates terms.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(0x80)).lower() + bytes(range(0x80, 0x100))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in counts.items():
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([in_docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            terms = text.as_py().encode("utf-8", "surrogatepass").translate(_TERMS).split()
            if not terms:
                continue
            n, in_docs = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            held -= len(n)
            n.update(terms)
            in_docs.update(set(terms))
            held += len(n)
            if held > FLUSH:
                yield from out()
                counts.clear()
                held = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term."""
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    each = given.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def share(n: Column, of: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (of + 2 terms))."""
    whole = lambda x: x.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + 2), whole(of + 2 * terms)).cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """``share`` of many counts: long division by three digits at a time, without overflow below 10^15."""
    rest, out = n + 2, np.zeros(len(n), np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // whole
        out, rest = out * 1000 + digit, rest - digit * whole
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Places (below 65,536) and counts, in as few bytes a count as the largest needs, after a byte that says how many."""
    kind = np.min_scalar_type(int(n.max(initial=0)))
    return bytes([kind.itemsize]) + at.astype("<u2").tobytes() + n.astype(kind.newbyteorder("<")).tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = packed[0]
    k = (len(packed) - 1) // (2 + width)
    return np.frombuffer(packed, "<u2", k, 1).astype(np.int64), np.frombuffer(packed, f"<u{width}", k, 1 + 2 * k).astype(np.int64)


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for row in b.column(3):
            at, n = (np.array(row.values.field(k), np.int64) for k in range(2))
            out.append(pack(at, n))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["lang", "g", "chunk", "packed"])


class _Tile:
    """The submatrix of one tile and stretch: groups of two blocks (of one, on the diagonal) and their sums so far."""

    def __init__(self) -> None:
        self.names: list[list[str]] = [[], []]
        self.place: list[dict[int, int]] = [{}, {}]
        self.whole: list[list[int]] = [[], []]
        self.sums = self.rest = None
        self.touched, self.chunk, self.rows = 0, -1, []

    def group(self, side: int, g: int, name: str, whole: int) -> None:
        self.place[side][g] = len(self.names[side])
        self.names[side].append(name)
        self.whole[side].append(whole)

    def vector(self, side: int, g: int, chunk: int, packed: bytes) -> None:
        if chunk != self.chunk:
            self.add()
            self.chunk = chunk
        self.rows.append((side, g, *unpack(packed)))

    def add(self) -> None:
        """The pairs' summands over the chunk at hand."""
        if not self.rows:
            return
        at = np.unique(np.concatenate([r[2] for r in self.rows]))
        two = bool(self.names[1])
        p = [np.stack([np.broadcast_to(shares(np.zeros(1, np.int64), w), len(at)) for w in self.whole[s]]) for s in range(1 + two)]
        for side, g, places, n in self.rows:
            k = self.place[side][g]
            p[side][k, np.searchsorted(at, places)] = shares(n, self.whole[side][k])
        if self.sums is None:
            self.sums = np.zeros((len(p[0]), len(p[-1])), np.int64)
        for k, own in enumerate(p[0]):
            self.sums[k] += distances(own, p[-1]).sum(1)
        self.touched += len(at)
        self.rows = []

    def out(self, lang: str) -> pa.RecordBatch:
        self.add()
        a, b = self.names[0], self.names[1] or self.names[0]
        none = [np.array([shares(np.zeros(1, np.int64), w)[0] if w else 1 for w in x]) for x in (self.whole[0], self.whole[1] or self.whole[0])]
        rest = distances(none[0][:, None], none[1][None])
        sums = self.sums if self.sums is not None else np.zeros((len(a), len(b)), np.int64)
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
        if not self.names[1]:
            i, j = i[i != j], j[i != j]  # both orders are there
        left, right, s, f = [a[k] for k in i], [b[k] for k in j], sums[i, j], rest[i, j]
        if self.names[1]:
            left, right, s, f = left + right, right + left, np.tile(s, 2), np.tile(f, 2)
        k = len(left)
        return pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(s), pa.array(np.full(k, self.touched)), pa.array(f)], ["lang", "source", "item", "sums", "touched", "rest"])


def _add_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, then groups before vectors, then by chunk: one chunk of one tile is held at a time."""
    key, tile = None, _Tile()
    for b in batches:
        for lang, i, j, stretch, chunk, side, g, name, whole, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (lang, i, j, stretch) != key:
                if key:
                    yield tile.out(key[0])
                key, tile = (lang, i, j, stretch), _Tile()
            if packed is None:
                tile.group(side, g, name, int(whole))
            else:
                tile.vector(side, g, chunk, packed)
    if key:
        yield tile.out(key[0])


def _pairs(groups: DataFrame, packed: DataFrame, block: int, stretch: int) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    b = F.floor(F.col("g") / block).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / block).cast("int")), lambda x: F.struct(F.least(x, b).alias("i"), F.greatest(x, b).alias("j"), (b > x).cast("int").alias("side")))
    none = lambda kind: F.lit(None).cast(kind)
    names = ["lang", "i", "j", "stretch", "chunk", "side", "g", "source", "whole", "packed"]
    stretches = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("chunks") / stretch).cast("int") - 1))
    heads = groups.select("lang", "g", "source", "groups", (F.col("n") + 2 * F.col("terms")).cast("string").alias("whole"), F.explode(stretches).alias("stretch"))
    heads = heads.select("*", F.explode(tiles).alias("t")).select("lang", "t.i", "t.j", "stretch", F.lit(-1).alias("chunk"), "t.side", "g", "source", "whole", none("binary").alias("packed"))
    vectors = packed.join(groups.select("lang", "g", "groups"), ["lang", "g"]).select("lang", "g", "chunk", "packed", F.explode(tiles).alias("t"))
    vectors = vectors.select("lang", "t.i", "t.j", F.floor(F.col("chunk") / stretch).cast("int").alias("stretch"), "chunk", "t.side", "g", none("string").alias("source"), none("string").alias("whole"), "packed")
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.union(vectors).select(*names).repartition(parts, "lang", "i", "j", "stretch").sortWithinPartitions("lang", "i", "j", "stretch", "chunk", "side", "g")
    sums = dealt.mapInArrow(_add_tiles, "lang string, source string, item string, sums long, touched long, rest long").groupBy("lang", "source", "item").agg(F.sum("sums").alias("sums"), F.sum("touched").alias("touched"), F.max("rest").alias("rest"))
    of = groups.select("lang", "source", "terms")
    return sums.join(of, ["lang", "source"]).select("lang", "source", "item", (F.col("sums") + (F.col("terms") - F.col("touched")) * F.col("rest")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, chunk: int = CHUNK, stretch: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from every other of its language (part ``pair``),
    and the ``top`` terms that it uses more than its language does (part ``term``).

    A language keeps the terms of at least ``least`` of its documents.  Null lang, source and text count as empty;
    rows that repeat are documents like others.  Every source that occurs has its pairs, also without any term; where
    a language keeps no term, all values are 0.  Ties are ranked by item.  Very long texts are counted whole, other
    columns are not read.  No rows, no rows.
    """
    chunk = min(chunk, 1 << 15)
    with temporary(docs.sparkSession):
        counts = save(term_counts(docs), "terms")
        used = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        used = save(used.select("lang", "term", "all_n"), "terms-used")
        langs = save(used.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_n")).withColumn("chunks", F.ceil(F.col("terms") / chunk).cast("int")), "langs")
        held = F.broadcast(langs) if langs.limit(HELD_LANGS + 1).count() <= HELD_LANGS else langs  # checked
        # Chunks by hash are about equal: of 2^15 terms on average none reaches the 2^16 places that a pack can name.
        dealt = used.join(held, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
        numbered = dealt.withColumn("at", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).cast("int"))
        kept = save(counts.drop("docs").join(numbered.select("lang", "term", "all_n", "chunk", "at"), ["lang", "term"]), "terms-kept")
        seen = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        groups = seen.join(own, ["lang", "source"], "left").join(held, "lang", "left").fillna(0)
        by_lang = Window.partitionBy("lang")
        groups = groups.withColumn("g", (F.row_number().over(by_lang.orderBy("source")) - 1).cast("int")).withColumn("groups", F.count("*").over(by_lang).cast("int"))
        groups = save(groups, "groups")
        vectors = kept.join(groups.select("lang", "source", "g"), ["lang", "source"]).groupBy("lang", "g", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("v"))
        packed = save(vectors.mapInArrow(_pack_rows, "lang string, g int, chunk int, packed binary"), "packed")
        pairs = save(_pairs(groups, packed, block, stretch).select("lang", "source", F.lit("pair").alias("part"), "item", "value"), "pairs", kept=True)
        p, q = share(F.col("n"), F.col("group_n"), F.col("terms")), share(F.col("all_n"), F.col("lang_n"), F.col("terms"))
        of = groups.select("lang", "source", F.col("n").alias("group_n"), "terms", "lang_n")
        terms = kept.join(of, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
        terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        by = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
        best = save(terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top), "terms-best", kept=True)
    return pairs.withColumn("rank", F.row_number().over(by)).union(best)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
used AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS terms, sum(all_n) AS lang_n FROM used GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM w JOIN used USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT x.lang, x.source, coalesce(sum(n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN own USING (lang, source) GROUP BY x.lang, x.source),
p AS (SELECT g.lang, g.source, u.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (group_n + 2 * terms)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (all_n + 2) // (lang_n + 2 * terms)::HUGEINT AS q
  FROM g JOIN langs USING (lang) JOIN used u USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = u.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= 10
"""
