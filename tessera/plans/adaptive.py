"""The adaptive question-answering plan: wide stages over a batch of questions.

Questions are classified, looked up in the answer cache, sent to keyword, vector or fused
retrieval, reranked, answered, scored and gated; those that fail are rewritten and go round
again, at most ``max_corrections`` times, then to the web source.  Each round's table is
written to the shared folder, so that lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Settings
from tessera.functions.scalar import cache_key
from tessera.operators import cache as c
from tessera.operators import quality as q
from tessera.operators.bm25 import Bm25Index
from tessera.operators.fusion import rerank, rerank_fallback, rrf, union_first
from tessera.operators.vector import batch_top_k
from tessera.plans.checkpoints import StateLog
from tessera.plans.subqueries import run_sub_queries
from tessera.schemas import CACHE
from tessera.sources.files import web_search
from tessera.sources.providers import Checkpointer, Embedder, HashEmbedder, Offline, OverlapReranker, Provider, Reranker, SharedFolder, embed_distinct


@dataclass
class Engine:
    """A corpus (chunk_id, source, content) with its indexes, cache and providers.

    ``events`` has a row a node that ran, failed ones too: a search that fails leaves the other's passages, a critic that fails leaves
    answers without scores, which do not pass, and a generator that fails leaves no answer.
    """

    corpus: DataFrame
    settings: Settings = DEFAULTS
    embedder: Embedder = field(default_factory=HashEmbedder)
    provider: Provider = field(default_factory=Offline)
    cache: DataFrame | None = None
    web_pages: DataFrame | None = None
    reranker: Reranker = field(default_factory=OverlapReranker)
    checkpointer: Checkpointer = field(default_factory=SharedFolder)
    events: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.index = Bm25Index.build(self.corpus, self.settings).clustered()
        self.vectors = self._keep(embed_distinct(self.corpus.select("chunk_id", "content"), "content", self.embedder).select(F.col("chunk_id").alias("id"), "embedding"), "vectors")

    def _keep(self, df: DataFrame, tag: str = "kept") -> DataFrame:
        return self.checkpointer.keep(df, tag)

    def _try(self, node: str, *ways: Callable[[], DataFrame]) -> DataFrame:
        """What the first of ``ways`` gives that does not fail; an event for each that was tried.  The last one's failure is raised."""
        for k, way in enumerate(ways):
            began = time.time()
            try:
                out, failed = way(), None
            except Exception as e:  # providers are other people's code
                out, failed = None, e
            self.events.append((node, "failed" if failed else "done", began, (time.time() - began) * 1000, type(failed).__name__ if failed else ""))
            if failed is None:
                return out
            if k == len(ways) - 1:
                raise failed

    def trace(self, spark: SparkSession, session: str) -> DataFrame:
        """The events so far as a table of traces."""
        rows = [(session, k, node, status, began, ms, detail) for k, (node, status, began, ms, detail) in enumerate(self.events)]
        given = spark.createDataFrame(rows, "session_id string, step int, node_name string, status string, began double, duration_ms double, detail string")
        return given.select("session_id", "step", "node_name", "status", F.timestamp_seconds("began").alias("started_at"), "duration_ms", F.lit("").alias("summary"), "detail")

    def _retrieve(self, asked: DataFrame) -> DataFrame:
        """(query_id, chunk_id, rank) by each question's strategy; empty where the corpus is."""
        s = self.settings
        text = asked.select("query_id", F.col("active_query").alias("query"), "strategy")
        none = lambda score: lambda: asked.select("query_id").join(self.corpus.select("chunk_id").limit(0)).select("query_id", "chunk_id", F.lit(0.0).alias(score), F.lit(0).alias("rank"))
        words = self._try("retrieve_bm25", lambda: self._keep(self.index.top_k(text.where("strategy <> 'vector'"), s.bm25_top_k)), none("bm25_score"))

        def search() -> DataFrame:
            embedded = embed_distinct(text.where("strategy <> 'bm25'"), "query", self.embedder).select("query_id", "embedding")
            return self._keep(batch_top_k(self.vectors, embedded, s.vector_top_k).withColumnRenamed("id", "chunk_id"))

        near = self._try("retrieve_vector", search, none("vector_score"))
        fused = rrf(words, near, s.rrf_k)
        return fused.select("query_id", "chunk_id", "rank")

    def _decompose(self, asked: DataFrame) -> DataFrame | None:
        """Scored answers of the multi-hop questions among ``asked``, put together from their sub-queries' answers; None without any."""
        subs = self.provider.sub_queries(F.col("query"))
        many = asked.where(q.should_decompose(F.col("is_multi_hop"), subs, F.col("attempts"))).withColumn("sub_query", subs)
        each = self._keep(many.select("query_id", "strategy", F.posexplode("sub_query").alias("sub_idx", "sub_query")), "sub-queries")
        if each.isEmpty():
            return None
        runs = self._keep(run_sub_queries(self.index, self.vectors, self.corpus, each, self.embedder, self.provider, self.settings, self.reranker), "sub-runs")
        part = F.concat(F.lit("Q"), (F.col("sub_idx") + 1).cast("string"), F.lit(": "), "sub_query", F.lit("\nA"), (F.col("sub_idx") + 1).cast("string"), F.lit(": "), "answer")
        joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub_idx", x.alias("t")))), lambda y: y["t"]), "\n\n")
        whole = runs.groupBy("query_id").agg(joined(part).alias("parts"), joined(F.col("answer")).alias("plain"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sub_idx", "chunks_used"))), lambda y: y["chunks_used"])).alias("used"))
        # Of all sub-queries' passages each stays once, where it came first.
        place = F.transform("used", lambda x, k: F.struct(x["chunk_id"].alias("id"), x["content"].alias("content"), k.alias("k")))
        once = F.filter(place, lambda x: F.array_position(F.transform("used", lambda y: y["chunk_id"]), x["id"]) == x["k"] + 1)
        out = many.drop("sub_query").join(whole, "query_id").withColumn("once", once)
        out = out.withColumns({"best": self.provider.synthesise(F.col("query"), F.col("parts"), F.col("plain")), "context": F.array_join(F.transform("once", lambda x: x["content"]), "\n\n---\n\n"), "n_chunks": F.size("once").cast("bigint"), "decomposed": F.lit(True)})
        return self._scored("synthesise", out.drop("parts", "plain", "used", "once"), F.col("best"))

    def _answer(self, asked: DataFrame) -> DataFrame:
        s = self.settings
        found = self._retrieve(asked).join(self.corpus.select("chunk_id", "content"), "chunk_id").join(asked.select("query_id", F.col("active_query").alias("query")), "query_id")
        texts = self.corpus.select("chunk_id", "content")
        # A reranker that fails leaves the order of the search.
        ways = (lambda: rerank(found, s.rerank_top_k, self.reranker.score(F.col("query"), F.col("content"))), lambda: rerank_fallback(found, s.rerank_top_k))
        top = self._try("rerank", *(lambda way=way: self._keep(way().join(texts, "chunk_id"), "reranked") for way in ways))
        best = top.groupBy("query_id").agg(F.min_by("content", "post_rerank_position").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post_rerank_position", "content"))), lambda x: x["content"]), "\n\n---\n\n").alias("context"), F.count("*").alias("n_chunks"))
        return self._scored("generate_and_evaluate", asked.join(best, "query_id", "left"))

    def _scored(self, node: str, answered: DataFrame, answer: Column | None = None) -> DataFrame:
        """``answered`` with its scores, without them if the critic fails, also without an answer if the generator does."""
        ways = [lambda: self._score(answered, answer), lambda: self._score(answered, answer, critic=False), lambda: self._score(answered, F.lit(None).cast("string"), critic=False)]
        return self._try(node, *(lambda way=way: self._keep(way(), "scored") for way in ways))

    def _score(self, answered: DataFrame, answer: Column | None = None, critic: bool = True) -> DataFrame:
        p, s = self.provider, self.settings
        out = answered.withColumn("answer", p.answer(F.col("active_query"), F.col("best")) if answer is None else answer)
        none = F.lit(None).cast("double")
        f, r, g = p.scores(F.col("active_query"), F.col("answer"), F.coalesce("context", F.lit(""))) if critic else (none, none, none)
        out = out.withColumns({"faithfulness": f, "answer_relevancy": r, "context_groundedness": g, "n_chunks": F.coalesce("n_chunks", F.lit(0))})
        f, r, g = F.col("faithfulness"), F.col("answer_relevancy"), F.col("context_groundedness")
        return out.withColumns({"composite_score": q.composite(f, r, g), "passed": F.coalesce(~q.below_threshold(f, r, g, s), F.lit(False))}).drop("best", "context")

    def ask(self, questions: DataFrame, log: StateLog | None = None, thread: str = "default") -> DataFrame:
        """One row a question (query_id, query): answer, strategy, scores, band, corrections, flags.

        Passed answers that did not come from the cache are written to it, so ``self.cache`` grows.
        """
        for _, table in self.ask_iter(questions, log, thread):
            out = table
        return out

    def ask_iter(self, questions: DataFrame, log: StateLog | None = None, thread: str = "default") -> Iterator[tuple[str, DataFrame]]:
        """(node, table) for a caller that shows progress, an event a node that ran; the last is ``done`` with the answers.

        With a ``log`` the state after each node is appended to its ``thread``, and a thread that was broken off goes on after
        its last whole node: the cache of that state takes the place of this engine's, and ``questions`` are those it began with.
        """
        last = log.latest(thread) if log else None
        state, t = (dict(last.values), dict(last.tables)) if last else ({"next": "classify_query", "turn": 0, "done": 0}, {})
        if "cache" in t:
            self.cache = t["cache"]
        if last and not state["next"]:
            yield "done", t["out"]
        while node := state["next"]:
            began = time.time()
            shown = getattr(self, f"_at_{node}")(questions, state, t)
            self.events.append((node, "done", began, (time.time() - began) * 1000, ""))
            if log:
                t = log.append(thread, node, state, t).tables
            yield from shown

    def _end(self, state: dict, t: dict[str, DataFrame], rows: DataFrame) -> None:
        """``rows`` need no further node before the last."""
        t[f"end{state['done']}"] = rows
        state["done"] += 1

    def _at_classify_query(self, questions: DataFrame, state: dict, t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        kind = self.provider.classify(F.col("query"))
        start = questions.select("query_id", "query").withColumns({"active_query": F.col("query"), "query_type": kind, "strategy": q.strategy_of(kind), "is_multi_hop": kind == "multi_hop", "attempts": F.lit(0), "web_used": F.lit(False), "decomposed": F.lit(False)})
        t["start"] = self._keep(start, "classified")
        state["next"] = "check_cache" if self.cache is not None else "decompose_query"
        return [("classify_query", t["start"])]

    def _at_check_cache(self, questions: DataFrame, state: dict, t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        hits, t["start"] = self._from_cache(t["start"])
        self._end(state, t, hits)
        state["next"] = "decompose_query"
        return [("check_cache", hits)]

    def _at_decompose_query(self, questions: DataFrame, state: dict, t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        state["next"] = "retrieve_and_generate"
        split = self._decompose(t["start"])
        if split is None:
            t["now"] = t["start"]
            return []
        t["split"] = split
        t["now"] = self._keep(t["start"].join(split.select("query_id"), "query_id", "left_anti"), "whole")
        return [("decompose_query", split)]

    def _at_retrieve_and_generate(self, questions: DataFrame, state: dict, t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        t["scored"] = self._answer(t.pop("now"))
        state["next"] = "evaluate_answer"
        return [("retrieve_and_generate", t["scored"])]

    def _at_evaluate_answer(self, questions: DataFrame, state: dict, t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        s, scored = self.settings, t.pop("scored")
        if "split" in t:  # answered in the first turn
            scored = scored.unionByName(t.pop("split").select(*scored.columns))
        route = q.route_after_evaluate(F.col("passed"), F.col("attempts"), F.col("web_used"), F.col("query_type"), s.max_corrections)
        state["next"] = "finalize_answer"
        if state["turn"] < s.max_corrections:
            self._end(state, t, scored.where(route != "rewrite_query"))
            again = scored.where(route == "rewrite_query")
            if not again.isEmpty():
                t["again"], state["next"] = again, "rewrite_query"
        elif self.web_pages is None:
            self._end(state, t, scored)
        else:
            self._end(state, t, scored.where(route != "web_search"))
            t["to_web"], state["next"] = scored.where(route == "web_search"), "web_search"
        return [("evaluate_answer", scored.select("query_id", "composite_score", "passed", route.alias("route")))]

    def _at_rewrite_query(self, questions: DataFrame, state: dict, t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        names = t["start"].columns
        now = t.pop("again").select(*(x for x in names if x not in ("active_query", "attempts")), self.provider.rewrite(F.col("query")).alias("active_query"), (F.col("attempts") + 1).alias("attempts"))
        t["now"] = now.select(*names)
        state["turn"] += 1
        state["next"] = "retrieve_and_generate"
        return [("rewrite_query", t["now"])]

    def _at_web_search(self, questions: DataFrame, state: dict, t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        found = self._from_web(t.pop("to_web"))
        self._end(state, t, found)
        state["next"] = "finalize_answer"
        return [("web_search", found)]

    def _at_finalize_answer(self, questions: DataFrame, state: dict, t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        t["out"] = self._keep(self._finalize([t.pop(f"end{k}") for k in range(state["done"])]), "answers")
        state["next"] = "done"
        return [("finalize_answer", t["out"])]

    def _at_done(self, questions: DataFrame, state: dict, t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        self._remember(t["out"])
        t["cache"], state["next"] = self.cache, ""
        return [("done", t["out"])]

    def _from_cache(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Questions with an entry, of the same text or else similar enough, and the others."""
        s = self.settings
        names = ("answer", "faithfulness", "answer_relevancy", "context_groundedness", "composite_score")
        entries = self._keep(c.live(self.cache, F.current_timestamp()), "cache-live")
        looked = self._keep(c.exact_tier(asked, entries.select("cache_key", *names)), "cache-exact")
        found = looked.where("hit").drop("hit")
        rest = looked.where("NOT hit").select(*asked.columns)
        embedded = embed_distinct(rest, "query", self.embedder).select("query_id", "embedding")
        ranked = entries.select(F.col("cache_key").alias("entry_id"), "embedding", F.col("created_at").alias("recency"))
        near = c.semantic_tier(embedded, ranked, s.cache_similarity, s.cache_window).where("hit")
        like = self._keep(rest.join(near.select("query_id", "entry_id", "similarity"), "query_id").join(entries.select(F.col("cache_key").alias("entry_id"), *names), "entry_id").withColumnRenamed("entry_id", "cache_key"), "cache-semantic")
        hits = found.unionByName(like.select(*found.columns)).withColumns({"passed": F.lit(True), "cached": F.lit(True), "n_chunks": F.lit(0).cast("bigint")})
        return hits, self._keep(rest.join(like.select("query_id"), "query_id", "left_anti"), "cache-missed")

    def _remember(self, answers: DataFrame) -> None:
        """Write passed answers to the cache; of one key the answer of the last question holds."""
        fresh = embed_distinct(answers.where("passed AND NOT served_from_cache"), "query", self.embedder)
        now = F.current_timestamp()
        rows = fresh.select("cache_key", "query", "answer", "embedding", "faithfulness", "answer_relevancy", "context_groundedness", "composite_score", "strategy", F.col("attempts").alias("correction_attempts"), F.lit(0).cast("bigint").alias("hit_count"), now.alias("created_at"), F.timestamp_add("SECOND", F.lit(self.settings.cache_ttl_seconds), now).alias("expires_at"), F.lit(True).alias("evaluation_passed"), F.xxhash64("query_id").alias("seq"))
        rows = rows.withColumn("seq", F.when(F.col("seq") < 0, -(F.col("seq") + 1)).otherwise(F.col("seq")))
        old = self.cache if self.cache is not None else answers.sparkSession.createDataFrame([], CACHE)
        self.cache = self._keep(c.write(old.select(*(x for x in rows.columns if x not in ("evaluation_passed", "seq"))), rows), "cache")

    def _from_web(self, rows: DataFrame) -> DataFrame:
        """Answers from the web source; a question's corpus passages stay its evidence where it has any."""
        found = web_search(self.web_pages, rows.select("query_id", F.col("active_query").alias("query")), self.settings.web_results)
        best = found.groupBy("query_id").agg(F.min_by("content", "rank").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("context"))
        base = rows.select("query_id", "query", "active_query", "query_type", "strategy", "is_multi_hop", "attempts", F.lit(True).alias("web_used"), "decomposed", "n_chunks")
        return self._scored("answer_from_web", base.join(best, "query_id", "left"))

    def _finalize(self, parts: list[DataFrame]) -> DataFrame:
        cols = ["query_id", "query", "active_query", "query_type", "strategy", "attempts", "web_used", "decomposed", "n_chunks", "answer", "faithfulness", "answer_relevancy", "context_groundedness", "composite_score", "passed"]
        out = None
        for x in parts:
            cached = "cached" in x.columns
            x = x.select(*cols, F.lit(cached).alias("served_from_cache"), (F.col("similarity") if cached else F.lit(0.0)).alias("similarity"))
            out = x if out is None else out.unionByName(x)
        conf = q.confidence(F.col("composite_score"), F.col("attempts"), F.col("served_from_cache"), F.col("similarity"))
        return out.withColumns({"confidence_label": q.band(conf), "confidence_score": q.band_score(conf), "gate_passed": q.gate_passed(F.col("passed"), F.col("served_from_cache")), "corrections_exhausted": q.exhausted(F.col("passed"), F.col("served_from_cache"), F.col("attempts")), "cache_key": cache_key(F.col("query"))})

    def health(self) -> dict[str, object]:
        return {"status": "healthy", "chunks": self.corpus.count(), "web_search": "configured" if self.web_pages is not None else "not configured"}


def union_sub_results(ranked: DataFrame) -> DataFrame:
    return union_first(ranked, "sub_idx", "rank")


def session_state(spark: SparkSession, states: DataFrame, session: str) -> DataFrame:
    return states.where(F.col("session_id") == session).orderBy(F.col("step").desc()).limit(1)
