"""The engine's queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as s
from tessera.operators import cache, evaluate, fusion, ingest, ivf, keyed, quality, runs, sentences, tables, trace, vector
from tessera.operators.blockmax import BlockMaxIndex
from tessera.operators.bm25 import Bm25Index
from tessera.operators.interaction import LateInteraction
from tessera.plans import adaptive, subqueries
from tessera.plans.frames import SCORES_SQL, corpus, questions, scores, table, vectors
from tessera.sources import files, providers
from tessera.storage import keep, new_path
from tessera.streaming import answers, sink

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL pieces -------------------------------------------------------------------------
TOK = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2)"
RND = "(floor(({0}) * 1e{1} + 0.5e0)::DOUBLE / 1e{1})"
COS = "CASE WHEN sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) = 0 THEN 0e0 ELSE list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))) END"


def rnd(x: str, n: int) -> str:
    return RND.format(x, n)


BM25 = f"""
tok AS (SELECT doc_id AS chunk_id, {TOK.format('text')} AS t FROM documents),
dl AS (SELECT chunk_id, len(t) AS dl FROM tok),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tok) GROUP BY 1, 2),
corp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(((SELECT n FROM corp) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS raw_idf FROM post GROUP BY 1),
mean AS (SELECT avg(raw_idf) AS mean_idf FROM raw),
idf AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25e0 * (SELECT mean_idf FROM mean) ELSE raw_idf END AS idf FROM raw),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, chunk_id, {rnd("sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (1e0 - 0.75e0 + 0.75e0 * dl / (SELECT avgdl FROM corp))))", 6)} AS score
  FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (chunk_id) GROUP BY 1, 2),
allsc AS (SELECT b.item_id AS query_id, d.chunk_id, coalesce(sc.score, 0e0) AS bm25_score FROM benchmark b CROSS JOIN dl d LEFT JOIN sc ON sc.query_id = b.item_id AND sc.chunk_id = d.chunk_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS rank FROM allsc)
"""
VEC = f"""
vs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {rnd(COS.format('q.embedding::DOUBLE[]', 'v.embedding::DOUBLE[]'), 6)} AS vector_score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, id) AS rank FROM vs)
"""


def index(spark: SparkSession, sf: str) -> Bm25Index:
    return Bm25Index.build(corpus(spark, sf))


# --- BM25 -------------------------------------------------------------------------------
@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def bm25_tokens(spark, sf):
    t = corpus(spark, sf).select(F.col("chunk_id").alias("doc_id"), s.tokens(F.col("content")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join("t", " ").alias("tokens"))


@query(f"WITH {BM25} SELECT term, df, {rnd('idf', 6)} AS idf FROM idf")
def bm25_term_stats(spark, sf):
    return index(spark, sf).idf().select("term", "df", s.exact_round(F.col("idf"), 6).alias("idf"))


@query(f"WITH {BM25} SELECT n AS n_docs, {rnd('avgdl', 6)} AS avgdl, {rnd('mean_idf', 6)} AS mean_idf FROM corp, mean")
def bm25_corpus_stats(spark, sf):
    return index(spark, sf).corpus.select("n_docs", s.exact_round(F.col("avgdl"), 6).alias("avgdl"), s.exact_round(F.col("mean_idf"), 6).alias("mean_idf"))


@query(f"WITH {BM25} SELECT chunk_id, bm25_score, rank FROM rk WHERE query_id = 0 AND rank <= 20")
def bm25_topk(spark, sf):
    """Top 20 for one question, benchmark item 0."""
    return index(spark, sf).top_k(questions(spark, sf).where("query_id = 0"), 20).select("chunk_id", "bm25_score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, bm25_score, rank FROM rk WHERE rank <= 20")
def bm25_batch_topk(spark, sf):
    return index(spark, sf).top_k(questions(spark, sf), 20).select("query_id", "chunk_id", "bm25_score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, bm25_score, rank FROM rk WHERE rank <= 20")
def bm25_blockmax_topk(spark, sf):
    """``bm25_batch_topk`` by blocks of postings, of which those below a question's threshold are skipped."""
    top = BlockMaxIndex.build(index(spark, sf)).top_k(questions(spark, sf), 20)
    return top.select("query_id", "chunk_id", "bm25_score", F.col("rank").cast("long").alias("rank"))


@query()
def rerank_late_interaction(spark, sf):
    """The best five of each question's 20 passages by late interaction of their tokens."""
    c, qs = corpus(spark, sf), questions(spark, sf)
    found = keep(index(spark, sf).top_k(qs, 20).join(c.select("chunk_id", "content"), "chunk_id").join(qs, "query_id"), "found")
    return fusion.rerank(found, 5, LateInteraction().score(F.col("query"), F.col("content")))


@query()
def bm25_blockmax_skipped(spark, sf):
    """Each question's blocks, those scored, and the share skipped."""
    counts = BlockMaxIndex.build(index(spark, sf)).top_k_counted(questions(spark, sf), 20)[1]
    return counts.withColumn("skipped", F.round(1 - F.col("scored") / F.col("blocks"), 4))


@query(f"""WITH alld AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 10, text FROM documents WHERE doc_id + 10 NOT IN (SELECT doc_id FROM documents)),
tok AS (SELECT doc_id, {TOK.format('text')} AS t FROM alld), corp AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
raw AS (SELECT term, ln(((SELECT n FROM corp) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS raw_idf FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM tok) GROUP BY 1)
SELECT n, {rnd('avgdl', 6)} AS avgdl, {rnd('(SELECT avg(raw_idf) FROM raw)', 6)} AS mean_idf FROM corp""")
def bm25_incremental(spark, sf):
    """Adding a shifted copy of the corpus indexes only the ids that are new; the sums follow."""
    c = corpus(spark, sf)
    both = index(spark, sf).add(c.withColumn("chunk_id", F.col("chunk_id") + 10))
    return both.corpus.select(F.col("n_docs").alias("n"), s.exact_round(F.col("avgdl"), 6).alias("avgdl"), s.exact_round(F.col("mean_idf"), 6).alias("mean_idf"))


# --- vectors and fusion -----------------------------------------------------------------
@query(f"WITH {VEC} SELECT id, vector_score FROM vr WHERE query_id = 0 AND rank <= 20")
def vector_topk(spark, sf):
    v = vectors(spark, sf)
    q = v.where("id = 0").first()
    return vector.top_k(v, q.embedding, 20)


@query(f"WITH {VEC} SELECT query_id, id, vector_score, rank FROM vr WHERE rank <= 20")
def vector_batch_topk(spark, sf):
    """Queries: every vector whose id is divisible by 50, against all."""
    v = vectors(spark, sf)
    return vector.batch_top_k(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), 20).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) AS chunks")
def index_counts(spark, sf):
    return trace.counters(vectors=vectors(spark, sf), chunks=corpus(spark, sf))


@query(f"""WITH {BM25}, {VEC}, l AS (SELECT query_id, chunk_id, bm25_score, rank AS r1 FROM rk WHERE rank <= 20 AND query_id % 50 = 0),
v AS (SELECT query_id, id AS chunk_id, vector_score, rank AS r2 FROM vr WHERE rank <= 20 AND query_id IN (SELECT item_id FROM benchmark)),
f AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.chunk_id, v.chunk_id) AS chunk_id, bm25_score, vector_score, r1, r2,
  {rnd("coalesce(1e0 / (60e0 + r1), 0e0) + coalesce(1e0 / (60e0 + r2), 0e0)", 6)} AS rrf_score FROM l FULL JOIN v ON l.query_id = v.query_id AND l.chunk_id = v.chunk_id)
SELECT query_id, chunk_id, bm25_score, vector_score, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, r1 NULLS LAST, r2 NULLS LAST) AS rank FROM f""")
def rrf_hybrid(spark, sf):
    """Questions divisible by 50, each with the vector of the same id."""
    qs, v = questions(spark, sf).where("query_id % 50 = 0"), vectors(spark, sf)
    near = vector.batch_top_k(v, v.where("id % 50 = 0").join(qs.select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding"), 20).withColumnRenamed("id", "chunk_id")
    return fusion.rrf(index(spark, sf).top_k(qs, 20), near).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, {rnd('0.95e0 - 0.08e0 * (rank - 1)', 3)} AS rerank_score, (rank - 1)::INT AS pre_rerank_position, (rank - 1)::INT AS post_rerank_position FROM rk WHERE rank <= 5")
def rerank_fallback(spark, sf):
    return fusion.rerank_fallback(index(spark, sf).top_k(questions(spark, sf), 20))


@query(f"""WITH {BM25}, t AS (SELECT rk.query_id, rk.chunk_id, rk.rank, list_distinct({TOK.format('b.text')}) AS qt, {TOK.format('d.text')} AS dt FROM rk JOIN benchmark b ON b.item_id = rk.query_id JOIN documents d ON d.doc_id = rk.chunk_id WHERE rank <= 20),
o AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0e0 ELSE {rnd('len(list_intersect(qt, dt))::DOUBLE / len(qt)', 6)} END AS rerank_score FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) - 1 AS post FROM o)
SELECT query_id, chunk_id, rerank_score, (rank - 1)::INT AS pre_rerank_position, post::INT AS post_rerank_position, (rank - 1 - post)::INT AS moved FROM p WHERE post < 5""")
def rank_delta(spark, sf):
    top = index(spark, sf).top_k(questions(spark, sf), 20).join(questions(spark, sf), "query_id").join(corpus(spark, sf).select("chunk_id", "content"), "chunk_id")
    return fusion.rerank(top).withColumn("moved", F.col("pre_rerank_position") - F.col("post_rerank_position"))


@query(f"WITH {BM25} SELECT chunk_id, query_id AS sub_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY query_id, rank) AS n FROM rk WHERE rank <= 10) WHERE n = 1")
def subquery_union_distinct(spark, sf):
    """The benchmark's items as sub-queries of ten chunks each; every chunk once, where it came first."""
    best = index(spark, sf).top_k(questions(spark, sf), 10).withColumnRenamed("query_id", "sub_idx")
    return adaptive.union_sub_results(best).select("chunk_id", "sub_idx", F.col("rank").cast("long").alias("rank"))


# --- cache ------------------------------------------------------------------------------
def turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


KEY = "'cache:' || substr(sha256(lower(trim({0}, ' '))), 1, 12)"


@query(f"""WITH e AS (SELECT {KEY.format('text')} AS cache_key, max(conv_id) AS entry FROM conversations WHERE role = 'user' AND turn = 0 GROUP BY 1),
q AS (SELECT conv_id, turn, {KEY.format('text')} AS cache_key FROM conversations WHERE role = 'user')
SELECT conv_id, turn, q.cache_key, coalesce(e.entry, -1) AS entry, e.entry IS NOT NULL AS hit, CASE WHEN e.entry IS NULL THEN 0e0 ELSE 1e0 END AS similarity FROM q LEFT JOIN e USING (cache_key)""")
def cache_exact_tier(spark, sf):
    """Entries: the opening turns; questions: every user turn."""
    t = turns(spark, sf)
    entries = t.where("turn = 0").groupBy(s.cache_key(F.col("query")).alias("cache_key")).agg(F.max("conv_id").alias("entry"))
    return cache.exact_tier(t, entries).select("conv_id", "turn", "cache_key", F.coalesce("entry", F.lit(-1)).alias("entry"), "hit", "similarity")


@query(f"""WITH r AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id DESC LIMIT 200),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS entry_id, {rnd(COS.format('q.embedding::DOUBLE[]', 'r.embedding::DOUBLE[]'), 6)} AS similarity FROM embeddings q CROSS JOIN r WHERE q.vec_id % 50 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id DESC) AS n FROM p)
SELECT query_id, entry_id, similarity, similarity >= 0.95e0 AS hit FROM b WHERE n = 1""")
def cache_semantic_tier(spark, sf):
    v = vectors(spark, sf)
    return cache.semantic_tier(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), v.select(F.col("id").alias("entry_id"), "embedding", F.col("id").alias("recency")))


def entries(spark, sf):
    """Each event as a cache entry of its user and type; the last write of a key holds."""
    e = table(spark, sf, "events").select(F.concat_ws("-", "user_id", "event_type").alias("cache_key"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 5).alias("hit_count"), F.col("event_id").alias("seq"))
    return cache.with_expiry(tables.upsert_latest(e, "cache_key", "seq"))


ENTRIES = "e AS (SELECT * FROM (SELECT user_id || '-' || event_type AS cache_key, ts, event_id % 5 AS hit_count, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1), now AS (SELECT max(ts) AS t FROM events)"


@query(f"WITH {ENTRIES} SELECT count(*) AS total_entries, coalesce(sum(hit_count), 0)::BIGINT AS total_hits FROM e, now WHERE ts + INTERVAL 7 DAY > t")
def cache_stats(spark, sf):
    now = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("now"))
    return cache.stats(cache.live(entries(spark, sf).crossJoin(now), F.col("now")))


@query(f"WITH {ENTRIES} SELECT cache_key, event_id AS seq, floor(epoch(ts + INTERVAL 7 DAY))::BIGINT AS expires FROM e, now WHERE ts + INTERVAL 7 DAY > t")
def cache_ttl_filter(spark, sf):
    now = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("now"))
    return cache.live(entries(spark, sf).crossJoin(now), F.col("now")).select("cache_key", "seq", F.unix_timestamp("expires_at").alias("expires"))


@query(f"""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '0.' || (event_id % 97 + 1) WHEN 1 THEN '' ELSE NULL END AS f, CASE WHEN event_id % 2 = 0 THEN '0.5' ELSE '' END AS rel FROM events),
t AS (SELECT event_id, coalesce(try_cast(nullif(trim(f), '') AS DOUBLE), 0e0) AS faithfulness, try_cast(nullif(trim(rel), '') AS DOUBLE) AS rr FROM r)
SELECT event_id, faithfulness, coalesce(rr, faithfulness) AS answer_relevancy, {rnd('0.5e0 * faithfulness + 0.3e0 * coalesce(rr, faithfulness) + 0.2e0 * faithfulness', 4)} AS composite_score FROM t""")
def cache_decode(spark, sf):
    i = F.col("event_id")
    raw = table(spark, sf, "events").select("event_id", F.when(i % 3 == 0, F.concat(F.lit("0."), (i % 97 + 1).cast("string"))).when(i % 3 == 1, "").alias("faithfulness"), F.when(i % 2 == 0, "0.5").otherwise("").alias("answer_relevancy"), F.lit(None).cast("string").alias("context_groundedness"), F.lit("").alias("composite_score"), F.lit("0").alias("hit_count"))
    return cache.decode(raw).select("event_id", "faithfulness", "answer_relevancy", "composite_score")


@query("""SELECT cache_key, event_id AS seq FROM (SELECT user_id::VARCHAR AS cache_key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1""")
def cache_write(spark, sf):
    """Events as answers, errors as failed ones: the last passed write of each key."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_id").alias("answer"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("evaluation_passed"))
    none = spark.createDataFrame([], "cache_key string, answer long")
    return cache.write(none, e).select("cache_key", F.col("answer").alias("seq"))


# --- quality ----------------------------------------------------------------------------
COMPOSITE = rnd("0.5e0 * coalesce(faithfulness, 0e0) + 0.3e0 * coalesce(answer_relevancy, 0e0) + 0.2e0 * coalesce(context_groundedness, 0e0)", 4)
LOW = "(coalesce(faithfulness < 0.75e0, true) OR coalesce(answer_relevancy < 0.70e0, true) OR coalesce(context_groundedness < 0.65e0, true))"
CONF = f"greatest(0e0, least(1e0, CASE WHEN cached THEN least(1e0, {COMPOSITE} + 0.05e0 * 1e0) ELSE {COMPOSITE} - 0.10e0 * attempts END))"


def three():
    return F.col("faithfulness"), F.col("answer_relevancy"), F.col("context_groundedness")


@query(f"SELECT event_id, {COMPOSITE} AS composite_score FROM ({SCORES_SQL})")
def composite_score(spark, sf):
    return scores(spark, sf).select("event_id", quality.composite(*three()).alias("composite_score"))


@query(f"SELECT event_id, {LOW} AS below_threshold, NOT {LOW} AS passed, CASE WHEN faithfulness IS NULL THEN NULL ELSE 1e0 - faithfulness END AS hallucination FROM ({SCORES_SQL})")
def quality_gate(spark, sf):
    low = quality.below_threshold(*three())
    return scores(spark, sf).select("event_id", low.alias("below_threshold"), (~low).alias("passed"), quality.hallucination(*three()).alias("hallucination"))


@query(f"SELECT event_id, CASE WHEN c >= 0.85e0 THEN 'VERIFIED' WHEN c >= 0.70e0 THEN 'PROBABLE' WHEN c >= 0.55e0 THEN 'UNCERTAIN' ELSE 'UNRELIABLE' END AS label, {rnd('c', 3)} AS score FROM (SELECT event_id, {CONF} AS c FROM ({SCORES_SQL}))")
def confidence_band(spark, sf):
    c = quality.confidence(quality.composite(*three()), F.col("attempts"), F.col("cached"), F.lit(1.0))
    return scores(spark, sf).select("event_id", quality.band(c).alias("label"), quality.band_score(c).alias("score"))


@query(f"SELECT event_id, CASE WHEN n_chunks = 0 AND NOT web_used AND NOT decomposed THEN 'web_search' WHEN decomposed THEN 'evaluate_answer' ELSE 'generate_answer' END AS route FROM ({SCORES_SQL})")
def route_after_rerank(spark, sf):
    return scores(spark, sf).select("event_id", quality.route_after_rerank(F.col("n_chunks"), F.col("web_used"), F.col("decomposed")).alias("route"))


@query(f"SELECT event_id, CASE WHEN NOT {LOW} THEN 'finalize_answer' WHEN NOT web_used AND query_type <> 'factual' AND attempts >= 3 THEN 'web_search' WHEN attempts < 3 THEN 'rewrite_query' ELSE 'finalize_answer' END AS route FROM ({SCORES_SQL})")
def route_after_evaluate(spark, sf):
    return scores(spark, sf).select("event_id", quality.route_after_evaluate(~quality.below_threshold(*three()), F.col("attempts"), F.col("web_used"), F.col("query_type")).alias("route"))


@query(f"SELECT event_id, (NOT {LOW}) OR cached AS gate_passed, {LOW} AND NOT cached AND attempts >= 3 AS exhausted FROM ({SCORES_SQL})")
def finalize_flags(spark, sf):
    ok = ~quality.below_threshold(*three())
    return scores(spark, sf).select("event_id", quality.gate_passed(ok, F.col("cached")).alias("gate_passed"), quality.exhausted(ok, F.col("cached"), F.col("attempts")).alias("exhausted"))


@query(f"""SELECT event_id, CASE WHEN cached THEN 'finalize_answer' ELSE 'route_retrieval' END AS after_cache,
CASE query_type WHEN 'factual' THEN 'retrieve_bm25' WHEN 'abstract' THEN 'retrieve_vector' ELSE 'retrieve_hybrid' END AS retrieval, query_type = 'multi_hop' AND n_chunks >= 2 AND attempts = 0 AS decompose FROM ({SCORES_SQL})""")
def routes(spark, sf):
    sub = F.array_repeat(F.lit("q"), F.col("n_chunks"))
    return scores(spark, sf).select("event_id", quality.route_after_cache(F.col("cached")).alias("after_cache"), quality.route_strategy(quality.strategy_of(F.col("query_type"))).alias("retrieval"), quality.should_decompose(F.col("query_type") == "multi_hop", sub, F.col("attempts")).alias("decompose"))


@query("SELECT conv_id, turn, trim(text, ' ') <> '' AND length(text) <= 2000 AS valid FROM conversations")
def request_validation(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", quality.valid_request(F.col("text"), F.lit(None).cast("string")).alias("valid"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN (event_id % 10) / 10e0 WHEN 1 THEN 1e0 WHEN 2 THEN 0e0 WHEN 3 THEN ('0.' || (event_id % 90 + 10))::DOUBLE WHEN 4 THEN NULL ELSE NULL END AS score FROM events""")
def score_parse(spark, sf):
    i = F.col("event_id")
    raw = F.when(i % 6 == 0, F.concat(F.lit('{"score": 0.'), (i % 10).cast("string"), F.lit(', "why": "x"}'))).when(i % 6 == 1, '{"score": 1.5}').when(i % 6 == 2, '{"score": -0.2}').when(i % 6 == 3, F.concat(F.lit("some text score is 0."), (i % 90 + 10).cast("string"), F.lit(" done"))).when(i % 6 == 4, "").otherwise('{"error": "0.5x"}')
    return table(spark, sf, "events").select("event_id", s.parse_score(raw).alias("score"))


# --- ingest -----------------------------------------------------------------------------
SENT = "list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\. '), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(f"SELECT doc_id, len(s) AS n_sentences, array_to_string(s, '|') AS sentences FROM (SELECT doc_id, {SENT} AS s FROM documents)")
def sentence_split(spark, sf):
    t = corpus(spark, sf).select(F.col("chunk_id").alias("doc_id"), s.sentences(F.col("content")).alias("s"))
    return t.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


@query("SELECT doc_id, substr(sha256(source || ':' || doc_id), 1, 12) AS chunk_id FROM documents")
def chunk_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", s.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"))


@query("""WITH l AS (SELECT source AS doc, doc_id AS page_num, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM documents),
p AS (SELECT *, lines[1] AS head, lines[len(lines)] AS foot, count(*) OVER (PARTITION BY doc) AS pages FROM l),
c AS (SELECT *, head IS NOT NULL AND count(*) OVER (PARTITION BY doc, head) > 0.5e0 * pages AS h, foot IS NOT NULL AND count(*) OVER (PARTITION BY doc, foot) > 0.5e0 * pages AS f FROM p),
t AS (SELECT doc, page_num, array_to_string(lines[(CASE WHEN h THEN 2 ELSE 1 END):(len(lines) - CASE WHEN f THEN 1 ELSE 0 END)], chr(10)) AS text FROM c)
SELECT * FROM t WHERE text <> ''""")
def header_footer(spark, sf):
    """Documents as the pages of their source."""
    return ingest.clean_pages(table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page_num"), "text"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'extension' WHEN n_chars < 1 THEN 'empty' WHEN n_chars > 52428800 THEN 'too_large' ELSE 'ok' END AS reason FROM documents")
def ingest_admission(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".TXT", ".md", ".exe"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", ingest.admission(F.concat(F.col("source"), ext), F.col("n_chars")).alias("reason"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def chunk_preview(spark, sf):
    return ingest.previews(corpus(spark, sf).select(F.col("chunk_id"), "content")).withColumnRenamed("chunk_id", "doc_id")


@query(f"WITH {BM25} SELECT query_id, string_agg('[Doc ' || rank || '] (relevance: ' || printf('%.2f', (round(bm25_score * 4) / 4)::DOUBLE) || ')' || chr(10) || text || chr(10) || 'Source: ' || source, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM rk JOIN documents d ON d.doc_id = rk.chunk_id WHERE rank <= 5 GROUP BY 1")
def context_block(spark, sf):
    """Scores in quarters, which both engines print alike."""
    top = index(spark, sf).top_k(questions(spark, sf), 5).join(corpus(spark, sf), "chunk_id")
    return ingest.context_block(top.select("query_id", "rank", "content", "source", (F.round(F.col("bm25_score") * 4) / 4).alias("score")))


@query("SELECT doc_id, substr(text, 1, 150) || chr(10) || substr(source, 1, 500) AS summary FROM documents")
def failure_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ingest.failure_summary(F.array("text"), F.col("source")).alias("summary"))


@query("""WITH k AS (SELECT item_id, list_slice(string_split(text, ' '), 1, 3) AS kws, text FROM benchmark)
SELECT item_id, len(list_filter(kws, lambda x: contains(lower(d.text), lower(x))))::DOUBLE / len(kws) AS rate FROM k JOIN documents d ON d.doc_id = k.item_id""")
def keyword_hit_rate(spark, sf):
    """Three words of every question in its answer, here the document of the same id."""
    k = table(spark, sf, "benchmark").select("item_id", F.slice(F.split("text", " "), 1, 3).alias("kws"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return d.join(k, "item_id").select("item_id", s.keyword_hit_rate(F.col("kws"), F.col("text")).alias("rate"))


#: A chunk is (s, f, e): its first sentence, its first one that is not overlap, its last; c are running token counts, p those before each sentence.
CHUNKS = f"""WITH RECURSIVE d AS (SELECT source || '/' || doc_id AS source, {SENT} AS s FROM documents),
n AS (SELECT source, s, list_transform(s, lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda t: t <> ''))) AS n FROM d WHERE len(s) > 0),
r AS (SELECT source, s AS sents, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])::BIGINT) AS c, list_transform(range(0, len(n)), lambda i: CASE WHEN i = 0 THEN 0 ELSE list_sum(n[1:i])::BIGINT END) AS p FROM n),
w AS (SELECT source, sents, c, p, 0 AS k, 1::BIGINT AS s, 1 + len(list_filter(c[2:], lambda x: x <= 512)) AS e FROM r
  UNION ALL SELECT source, sents, c, p, k + 1, s2, e + 1 + len(list_filter(c[e + 2:], lambda x: x - p[s2] <= 512)) FROM (SELECT *, e + 1 - len(list_filter(p[s:e], lambda x: c[e] - x <= 64)) AS s2 FROM w) WHERE e < len(c))
SELECT substr(sha256(source || ':' || chunk_index), 1, 12) AS chunk_id, source, content, chunk_index, token_count FROM (
  SELECT source, array_to_string(sents[s:e], ' ') AS content, (row_number() OVER (PARTITION BY source ORDER BY k) - 1)::INT AS chunk_index, (c[e] - p[s])::INT AS token_count FROM w WHERE c[e] - p[s] >= 100)"""


@query(CHUNKS)
def sliding_chunks(spark, sf):
    return ingest.chunks(table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("source"), "text"))


# --- tables -----------------------------------------------------------------------------
@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 300)")
def insert_ignore(spark, sf):
    e = table(spark, sf, "events")
    return tables.insert_ignore(e.where("event_type = 'error' and value > 300").select("user_id").distinct(), e.where("event_type = 'view'").select("user_id"), "user_id")


@query("SELECT conv_id AS session_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def upsert_latest(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    return tables.upsert_latest(c, "session_id", "turn")


@query("""WITH o AS (SELECT o_orderkey AS job_id, o_orderstatus AS status, o_custkey AS total FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS job_id, 'done' AS status, -1 AS total FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(n.job_id, o.job_id) AS job_id, CASE WHEN n.job_id IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN o.job_id IS NOT NULL THEN o.total ELSE n.total END AS total FROM o FULL JOIN n ON o.job_id = n.job_id""")
def eval_run_merge(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("total"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("done").alias("status"), F.lit(-1).cast("long").alias("total"))
    return tables.merge_eval_run(old, new)


@query("""SELECT c_custkey AS k, coalesce(a.v, b.v) AS v, coalesce(a.v, b.v) IS NOT NULL AS found FROM customer LEFT JOIN (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0) a ON a.k = c_custkey LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0) b ON b.k = c_custkey""")
def trace_lookup(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "k")
    return tables.lookup(c.where("k % 3 = 0").select("k", F.col("c_name").alias("v")), c.where("k % 2 = 0").select("k", F.col("c_mktsegment").alias("v")), c.select("k"), "k", "v")


# --- evaluation -------------------------------------------------------------------------
RESULTS = f"(SELECT *, {COMPOSITE} AS composite_score, attempts AS correction_attempts, value AS latency_ms, event_id % 11 <> 0 AS is_complete, cached AS served_from_cache, CASE query_type WHEN 'factual' THEN 'bm25' WHEN 'abstract' THEN 'vector' ELSE 'hybrid' END AS expected_strategy, CASE WHEN event_id % 3 = 0 THEN 'bm25' ELSE 'hybrid' END AS actual_strategy, event_type AS category, (event_id % 3)::DOUBLE / 2e0 AS keyword_hit_rate FROM ({SCORES_SQL}))"


def results(spark, sf):
    i = F.col("event_id")
    return scores(spark, sf).withColumns({"composite_score": quality.composite(*three()), "correction_attempts": F.col("attempts"), "latency_ms": F.col("value"), "is_complete": i % 11 != 0, "served_from_cache": F.col("cached"), "expected_strategy": quality.strategy_of(F.col("query_type")), "actual_strategy": F.when(i % 3 == 0, "bm25").otherwise("hybrid"), "category": F.col("event_type"), "keyword_hit_rate": (i % 3).cast("double") / 2.0})


def _rate(x: str, y: str = "count(*)") -> str:
    return f"CASE WHEN {y} > 0 THEN {rnd(f'({x})::DOUBLE / ({y})', 4)} ELSE 0e0 END"


@query(f"""SELECT count(*) AS total, count(*) FILTER (is_complete) AS completed, {_rate('count(*) FILTER (is_complete)')} AS completion_rate, {_rate('count(*) FILTER (actual_strategy = expected_strategy)')} AS strategy_accuracy,
{rnd('avg(faithfulness)', 4)} AS avg_faithfulness, {rnd('avg(answer_relevancy)', 4)} AS avg_answer_relevancy, {rnd('avg(context_groundedness)', 4)} AS avg_context_groundedness, {rnd('avg(composite_score)', 4)} AS avg_composite,
{_rate('count(*) FILTER (attempts > 0)')} AS correction_rate, {rnd('avg(attempts)', 4)} AS avg_corrections, {_rate('count(*) FILTER (attempts > 0 AND is_complete)', 'count(*) FILTER (attempts > 0)')} AS correction_success_rate,
{_rate('count(*) FILTER (cached)')} AS cache_hit_rate, {rnd('avg(latency_ms)', 1)} AS avg_latency_ms, {rnd('avg(keyword_hit_rate)', 4)} AS keyword_hit_rate,
{rnd('sum(latency_ms) / 60000e0', 2)} AS total_duration_minutes, {rnd('list_sort(list(latency_ms))[least(floor(count(*) * 0.95e0)::BIGINT, count(*) - 1) + 1]', 1)} AS p95_latency_ms,
min_by('critic-' || event_id % 2, event_id) FILTER (event_id % 9 <> 0) AS scorer_model, floor(epoch(max(ts)))::BIGINT AS run_timestamp FROM {RESULTS}""")
def eval_aggregate(spark, sf):
    """All keys of a report; the run's time is that of its last row."""
    i = F.col("event_id")
    rows = results(spark, sf).withColumn("scorer_model", F.when(i % 9 != 0, F.concat(F.lit("critic-"), (i % 2).cast("string"))))
    last = rows.agg(F.max("ts").cast("timestamp").alias("t")).first().t
    return evaluate.suite_report(rows, "event_id", F.unix_timestamp(F.lit(last)))


@query(f"SELECT category, count(*) AS n, count(*) FILTER (is_complete) AS completed, count(*) FILTER (actual_strategy = expected_strategy) AS strategy_ok, {rnd('avg(latency_ms)', 1)} AS avg_latency_ms FROM {RESULTS} GROUP BY 1")
def eval_by_category(spark, sf):
    return evaluate.by_category(results(spark, sf))


@query(f"SELECT event_type, {rnd('l[least(floor(len(l) * 0.95e0)::BIGINT, len(l) - 1) + 1]', 1)} AS p95 FROM (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY 1)")
def p95_runner(spark, sf):
    return evaluate.p95_runner(table(spark, sf, "events"), "value", "event_type")


@query("SELECT event_type, l[round_even((len(l) - 1) * 0.95e0, 0)::BIGINT + 1] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY 1)")
def p95_stress(spark, sf):
    return evaluate.p95_stress(table(spark, sf, "events"), "value", "event_type")


@query(f"SELECT event_type, {rnd('avg(value)', 4)} AS avg, median(value) AS p50, max(value) AS max, min(value) AS min, count(*) AS n FROM events GROUP BY 1")
def latency_summary(spark, sf):
    return evaluate.latency_summary(table(spark, sf, "events"), "value", "event_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY 1")
def strategy_counts(spark, sf):
    return evaluate.value_counts(table(spark, sf, "events"), "event_type")


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_sources(spark, sf):
    return evaluate.distinct_values(table(spark, sf, "documents"), "source")


@query("SELECT coalesce(min_by(event_type, event_id), 'unknown') AS event_type FROM events WHERE event_type IS NOT NULL")
def first_scorer(spark, sf):
    return evaluate.first_known(table(spark, sf, "events"), "event_type", "event_id")


@query(f"""WITH f AS (SELECT user_id, min_by(value, event_id) AS cold, min(event_id) AS o FROM events GROUP BY 1)
SELECT user_id, cold, {rnd('cold / nullif(avg(value), 0)', 4)} AS speed_up, count(*) FILTER (value < 500) AS hits FROM events JOIN f USING (user_id) WHERE event_id <> o GROUP BY 1, 2""")
def speed_up(spark, sf):
    return evaluate.speed_up(table(spark, sf, "events"), "value", "event_id", "user_id")


# --- traces -----------------------------------------------------------------------------
@query(f"SELECT user_id, event_id, value, {rnd('value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)', 6)} AS delta FROM events")
def score_delta(spark, sf):
    return trace.score_delta(table(spark, sf, "events"), "user_id", "event_id", "value")


@query("SELECT user_id, max_by(value, event_id) AS last FROM events GROUP BY 1")
def last_score(spark, sf):
    return trace.last_score(table(spark, sf, "events"), "user_id", "event_id", "value")


@query(f"SELECT user_id, {rnd('sum(coalesce(value, 0e0))', 4)} AS total_ms FROM events GROUP BY 1")
def trace_total_ms(spark, sf):
    return trace.total_ms(table(spark, sf, "events"), "user_id", "value")


@query("SELECT user_id, event_type, min_by(props, event_id) AS status FROM events GROUP BY 1, 2")
def node_first_status(spark, sf):
    return trace.first_status(table(spark, sf, "events"), "user_id", "event_type", "event_id", "props")


@query("SELECT e.user_id, e.event_id FROM events e LEFT JOIN (SELECT user_id, max(event_id) FILTER (event_type = 'view') AS last FROM events GROUP BY 1) s USING (user_id) WHERE s.last IS NULL OR e.event_id > s.last")
def trace_increment(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    seen = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("last"))
    return trace.new_steps(e.drop("event_type"), seen, "user_id", "event_id")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM conversations) AS turns, (SELECT count(*) FROM events) AS traces, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM benchmark) AS questions")
def system_stats(spark, sf):
    names = {"documents": "documents", "vectors": "embeddings", "turns": "conversations", "traces": "events", "pages": "pages", "questions": "benchmark"}
    return trace.counters(**{k: table(spark, sf, t) for k, t in names.items()})


@query("SELECT user_id, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS window_start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY 1, 2")
def rate_limit_windows(spark, sf):
    return trace.rate_windows(table(spark, sf, "events"), "user_id", "ts", 3600, 2)


@query("SELECT user_id, event_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def session_state(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("step"), "event_type", "ts", "value")
    return tables.latest_state(e).withColumnsRenamed({"session_id": "user_id", "step": "event_id"})


# --- more of ingest and tables -----------------------------------------------------------
@query("SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda t: t <> '')) AS n FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", s.token_count(F.col("text")).cast("long").alias("n"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1")
def sub_answer_synthesis(spark, sf):
    return ingest.synthesise(table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("answer")), "conv_id")


@query("SELECT user_id AS job_id, event_type AS status, event_id AS progress, 100000 AS total, event_id / 100000e0 AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def job_progress(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("event_id").alias("progress"), F.lit(100000).alias("total"))
    return tables.job_progress(e)


@query("SELECT source || '/' || doc_id AS doc_id, source AS filename, 1 AS chunk_count, n_chars AS indexed_at FROM documents")
def ingested_listing(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("doc_id"), F.col("source").alias("filename"), F.lit(1).alias("chunk_count"), F.col("n_chars").alias("indexed_at"))
    return tables.listing(d)


@query("SELECT (SELECT count(*) FROM documents) AS chunk_count, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)) AS bm25_inserted, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS vectors_inserted")
def dual_index_status(spark, sf):
    """Documents as chunks: the keyword index holds the benchmark's ids, the vector table those of the embeddings."""
    c = corpus(spark, sf)
    return ingest.dual_index(c, table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_id")), vectors(spark, sf).select(F.col("id").alias("chunk_id")), lambda df: df)[2]


@query("""SELECT item_id, kind AS query_type, CASE kind WHEN 'factual' THEN 'bm25' WHEN 'abstract' THEN 'vector' ELSE 'hybrid' END AS strategy, array_to_string(subs, '|') AS sub_queries, kind = 'multi_hop' AND len(subs) >= 2 AS decomposed FROM (
SELECT item_id, list_filter(list_transform(string_split_regex(text, '(?i)\\?\\s*|\\s+(?:and|versus|vs\\.?)\\s+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS subs,
CASE WHEN regexp_matches(lower(text), '\\b(compare|versus|vs|difference between)\\b|\\band\\b.*\\?.*\\?') THEN 'multi_hop' WHEN regexp_matches(lower(text), '\\b(latest|recent|today|current|now|this (week|month|year))\\b') THEN 'time_sensitive' WHEN regexp_matches(lower(text), '\\b(why|how|explain|describe)\\b') THEN 'abstract' ELSE 'factual' END AS kind
FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Compare this: ' || text WHEN 1 THEN 'Why? ' || text ELSE text END AS text FROM benchmark))""")
def classified_questions(spark, sf):
    """Types, strategies and sub-queries by rule; two of three questions get a word that tells their type."""
    i, p = F.col("item_id"), providers.Offline()
    q = table(spark, sf, "benchmark").select("item_id", F.when(i % 3 == 0, F.concat(F.lit("Compare this: "), "text")).when(i % 3 == 1, F.concat(F.lit("Why? "), "text")).otherwise(F.col("text")).alias("text"))
    kind, subs = p.classify(F.col("text")), p.sub_queries(F.col("text"))
    return q.select("item_id", kind.alias("query_type"), quality.strategy_of(kind).alias("strategy"), F.array_join(subs, "|").alias("sub_queries"), quality.should_decompose(kind == "multi_hop", subs, F.lit(0)).alias("decomposed"))


@query("SELECT user_id AS query_id, count(*) AS sub_query_count, count(*) FILTER (event_type <> 'error') AS successful_sub_queries FROM events GROUP BY 1")
def sub_query_successes(spark, sf):
    """Events as sub-query runs, errors as failed ones."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), (F.col("event_type") != "error").alias("success"))
    return subqueries.successes(e)


@query("""SELECT item_id, k, words[k + 1] AS word, sizes[k + 1] AS size FROM (SELECT item_id, words, sizes, unnest(range(0, least(len(words), len(sizes)))) AS k FROM
(SELECT item_id, string_split(text, ' ') AS words, list_slice(list_transform(string_split(text, ' '), lambda x: length(x)), 1, 4) AS sizes FROM benchmark))""")
def positional_zip(spark, sf):
    """Words and the first four words' lengths by place: the shorter list tells how many."""
    words = F.split("text", " ")
    b = table(spark, sf, "benchmark").select("item_id", words.alias("word"), F.slice(F.transform(words, lambda x: F.length(x).cast("long")), 1, 4).alias("size"))
    return subqueries.zipped(b, "word", "size").withColumn("k", F.col("k").cast("long"))


CACHE_TTL = 7_200


@query(f"""WITH e AS (SELECT *, event_type = 'signup' AS put FROM events),
x AS (SELECT event_id AS seq, user_id, put, ts, max(CASE WHEN put THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, NOT put, event_id ROWS UNBOUNDED PRECEDING) AS created FROM e),
h AS (SELECT *, NOT put AND created IS NOT NULL AND ts < created + INTERVAL {CACHE_TTL} SECOND AS hit FROM x)
SELECT user_id::VARCHAR AS cache_key, seq, hit, CASE WHEN hit THEN count_if(hit) OVER (PARTITION BY user_id, created ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT END AS hit_count FROM h WHERE NOT put""")
def cached_answer_hits(spark, sf):
    """Events as a stream of answers put under a user's key (signups) and asked for (all others), two hours to live: hits and their counts."""
    e = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    asked = e.select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "signup", "put").otherwise("get").alias("kind"), F.lit("a").alias("answer"))
    path = new_path(spark, "answers")
    answers.run(answers.answers(asked, CACHE_TTL), path, f"{path}-checkpoint")
    return spark.read.parquet(path).where("kind = 'get'").select("cache_key", "seq", "hit", "hit_count")


@query("SELECT user_id::VARCHAR AS session_id, event_id::INT AS step, event_type AS node_name, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, value AS duration_ms FROM events")
def progress_log(spark, sf):
    """Events as the progress of sessions, streamed into the sink and read back by its commits."""
    e = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    rows = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("int").alias("step"), F.col("event_type").alias("node_name"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.col("value").alias("duration_ms"))
    path = new_path(spark, "progress")
    sink.progress(rows, path, f"{path}-checkpoint").awaitTermination()
    return sink.events(spark, path).select(*rows.columns)


BARE = "regexp_replace(lower({0}), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}.]+$', '', 'g')"
TYPES = f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT unnest(w) AS token, unnest(list_append(w[2:], NULL)) AS after FROM w WHERE len(w) > 0),
b AS (SELECT token, {BARE.format('token')} AS b, after, {BARE.format('after')} AS ab FROM t),
k AS (SELECT token, regexp_replace(b, '\\.+$', '') AS type, regexp_matches(b, '(^|[^.])\\.$') AS dot, b, after, regexp_replace(ab, '\\.+$', '') AS nxt FROM b),
c AS (SELECT type, count_if(dot)::BIGINT AS with_period, count_if(NOT dot)::BIGINT AS without FROM k GROUP BY type),
s AS (SELECT sum(with_period)::DOUBLE AS dots, sum(with_period + without)::DOUBLE AS al FROM c),
a AS (SELECT type, with_period, without, -2e0 * (with_period * ln(dots / al) + without * ln(greatest(1e0 - dots / al, 1e-12)) - with_period * ln(0.99e0) - without * ln(1e0 - 0.99e0))
    * exp(-(length(type) - n)::DOUBLE) * (n + 1) * pow((length(type) - n)::DOUBLE, -without::DOUBLE) AS score
  FROM (SELECT *, length(regexp_replace(type, '[^.]', '', 'g')) AS n FROM c), s WHERE with_period > 0 AND regexp_matches(type, '\\p{{L}}') AND NOT regexp_matches(type, '\\p{{N}}')),
known AS (SELECT * FROM a WHERE score >= 0.3e0)"""
_CLOSE = r"[\)\]\}\"''’”»]*$"


@query(f"{TYPES} SELECT type, with_period, without, {rnd('score', 4)} AS score FROM known")
def sentence_abbreviations(spark, sf):
    """Types that nearly always end with a period, by their log-likelihood."""
    found = sentences.abbreviations(table(spark, sf, "documents"))
    return found.select("type", "with_period", "without", s.exact_round(F.col("score"), 4).alias("score"))


@query(f"""{TYPES},
e AS (SELECT k.nxt, count(*) AS n FROM k LEFT JOIN known ON known.type = k.type WHERE regexp_matches(k.token, '[.!?]{_CLOSE}') AND (known.type IS NULL OR NOT ends_with(k.b, '.')) GROUP BY k.nxt),
f AS (SELECT nxt AS type, n::DOUBLE AS ab, (SELECT sum(n) FROM e)::DOUBLE AS a, (with_period + without)::DOUBLE AS b, (SELECT al FROM s) AS n FROM e JOIN c ON c.type = e.nxt WHERE regexp_matches(nxt, '\\p{{L}}')),
l AS (SELECT *, b / n AS p, ab / a AS p1, (b - ab) / (n - a) AS p2 FROM f WHERE ab <= b AND n > a AND n * ab > a * b),
m AS (SELECT *, -2e0 * ((ab * ln(p) + CASE WHEN a > ab THEN (a - ab) * ln(1e0 - p) ELSE 0e0 END) + (CASE WHEN b > ab THEN (b - ab) * ln(p) ELSE 0e0 END + CASE WHEN n - a > b - ab THEN ((n - a) - (b - ab)) * ln(1e0 - p) ELSE 0e0 END)
  - (ab * ln(p1) + CASE WHEN a > ab THEN (a - ab) * ln(1e0 - p1) ELSE 0e0 END) - (CASE WHEN b > ab THEN (b - ab) * ln(p2) ELSE 0e0 END + CASE WHEN n - a > b - ab THEN ((n - a) - (b - ab)) * ln(1e0 - p2) ELSE 0e0 END)) AS score FROM l)
SELECT type, ab::BIGINT AS at_start, b::BIGINT AS total, {rnd('score', 2)} AS score FROM m WHERE score >= 30e0""")
def sentence_starters(spark, sf):
    """Types that follow sentence ends more often than chance, by their log-likelihood."""
    d = table(spark, sf, "documents")
    counts = keep(sentences.type_counts(d), "sentence-types")
    found = sentences.starters(d, keep(sentences.abbreviations(d, counts), "abbreviations"), counts)
    return found.select("type", "at_start", "total", s.exact_round(F.col("score"), 2).alias("score"))


@query()
def sentence_splits(spark, sf):
    """Sentences of every document by the learned ends."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return sentences.Splitter.learn(d).split(d, "doc_id")


@query("""SELECT event_type, n, value AS p95 FROM (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k FROM events WHERE value IS NOT NULL)
WHERE k = least(floor(n * 0.95e0), n - 1)""")
def runs_p95(spark, sf):
    """Events of a user and type as a run: a sketch is kept for each, and each type's are merged."""
    e = table(spark, sf, "events").select(F.concat_ws("/", "user_id", "event_type").alias("run"), "event_type", "value")
    kept = keep(runs.sketches(e, "run", "value").withColumn("event_type", F.substring_index("run", "/", -1)), "sketches")
    return runs.p95(kept, e.drop("event_type"), "run", "value", "event_type").withColumnRenamed("value", "p95")


_ORDERS = {"orders": ("o_orderkey", "o_orderkey bigint, o_custkey bigint, o_totalprice double")}


def _orders_store(spark, sf):
    """Orders put in by two transactions: two thirds of the keys, then all, with a raised price where the key is even."""
    store = keyed.KeyedStore(spark, new_path(spark, "keyed"), _ORDERS, buckets=8)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    with store.transaction() as tx:
        tx.insert_ignore("orders", o.where("o_orderkey % 3 <> 0"))
    with store.transaction() as tx:
        raised = o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1.0)
        tx.upsert("orders", raised.withColumn("n", F.lit(2)).union(raised.select("o_orderkey", "o_custkey", F.lit(0.0), F.lit(1))), "n")
        tx.insert_ignore("orders", o.withColumn("o_custkey", F.lit(-1).cast("long")))
    return store


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS o_custkey, o_totalprice::DOUBLE + CASE WHEN o_orderkey % 2 = 0 THEN 1e0 ELSE 0e0 END AS o_totalprice FROM orders")
def keyed_merge(spark, sf):
    """The last snapshot: inserts ignored where the key is there, the latest of each upserted key."""
    return _orders_store(spark, sf).read("orders")


@query("SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def keyed_snapshot(spark, sf):
    """The first snapshot, read after the second was committed."""
    return _orders_store(spark, sf).read("orders", 1)


PAGES = f"""pages_text AS (SELECT page_id AS doc_id, coalesce(url, '') AS url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') AS title,
  trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS text FROM pages),
pages_kept AS (SELECT * FROM pages_text WHERE text <> ''), {BM25.replace('FROM documents', 'FROM pages_kept')}"""


@query(f"WITH {PAGES} SELECT query_id, url, title, bm25_score AS score, rank FROM rk JOIN pages_kept p ON p.doc_id = rk.chunk_id WHERE rank <= 5")
def web_search(spark, sf):
    return files.web_search(table(spark, sf, "pages"), questions(spark, sf), 5).select("query_id", "url", "title", "score", F.col("rank").cast("long").alias("rank"))


# --- model-backed and iterative, without SQL --------------------------------------------
def _asked_vectors(v):
    return v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


def _near(spark, sf):
    v = vectors(spark, sf)
    index = ivf.InvertedFile.build(v)
    return index.batch_top_k(_asked_vectors(v), 20, probes=vector.probes_needed(index, v, 20))


@query()
def ann_topk(spark, sf):
    """Approximate neighbours, of the probed lists, of every vector whose id is divisible by 50."""
    return _near(spark, sf).withColumn("rank", F.col("rank").cast("long"))


def _recall(spark, sf):
    """Of each exact neighbour of the questions of ``ann_topk``, whether it was found."""
    v = vectors(spark, sf)
    exact = vector.batch_top_k(v, _asked_vectors(v), 20)
    return exact.join(_near(spark, sf).select("query_id", "id", F.lit(True).alias("found")), ["query_id", "id"], "left")


@query("SELECT count(*) AS questions, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark, sf):
    """Of the questions of ``ann_topk``, whether nine in ten of their exact neighbours are found."""
    return _recall(spark, sf).agg(F.count_distinct("query_id").alias("questions"), (F.count_if("found") >= 0.9 * F.count("*")).alias("enough"))


@query()
def ann_recall_counts(spark, sf):
    """The same as numbers: exact neighbours asked for and found, and the recall."""
    n = _recall(spark, sf).agg(F.count_distinct("query_id").alias("questions"), F.count("*").alias("asked"), F.count_if("found").alias("found"))
    return n.withColumn("recall", F.round(F.col("found") / F.col("asked"), 4))


@query("SELECT vec_id % 50 = 0 AND vec_id IS NOT NULL AS asked, count(*) AS vectors, count(*) AS indexed FROM embeddings GROUP BY 1")
def ann_index_rows(spark, sf):
    """Vectors that were asked for and others, and how many of each the lists' codes hold: every row is indexed."""
    v = vectors(spark, sf)
    index = ivf.InvertedFile.build(v)
    held = spark.read.parquet(f"{index.path}/codes").select(F.explode("ids").alias("id")).distinct().withColumn("there", F.lit(True))
    return v.select("id").join(held, "id", "left").groupBy((F.col("id") % 50 == 0).alias("asked")).agg(F.count("*").alias("vectors"), F.count_if("there").alias("indexed"))


@query()
def adaptive_ask(spark, sf):
    return adaptive.Engine(corpus(spark, sf), web_pages=table(spark, sf, "pages")).ask(questions(spark, sf))
