"""The engine's extension points, its failures, its state log, and the sink of its progress."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.config import Settings
from tessera.plans.adaptive import Engine
from tessera.plans.checkpoints import StateLog
from tessera.sources.providers import HashEmbedder, Offline, SharedFolder
from tessera.streaming import sink

CORPUS = [("c1", "s", "bm25 ranks passages by rare terms"), ("c2", "s", "vectors find similar meaning"), ("c3", "s", "filters spare shuffles")]
ASKED = [(1, "bm25 ranks passages"), (2, "why unrelated words fail entirely"), (3, "filters spare shuffles")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "chunk_id string, source string, content string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string")


def rows(df):
    return sorted((r.query_id, r.answer, r.attempts, r.passed, r.composite_score, r.confidence_label) for r in df.collect())


def fails(*_):
    raise ConnectionError("down")


def fails_late(text):
    """A provider that fails while the job runs."""

    def reply(_):
        raise ValueError("no reply")

    return F.udf(reply, StringType())(text)


def test_broken_off_threads_go_on(spark, corpus, asked, tmp_path):
    settings = Settings(max_corrections=1)
    want = rows(Engine(corpus, settings).ask(asked))
    log = StateLog(spark, f"file://{tmp_path}/log")
    nodes = []
    for stop in range(1, 20):
        # Each engine is a new one and is thrown away after its next node.
        events = Engine(corpus, settings).ask_iter(asked, log, "t")
        node, table = next(events)
        nodes.append(node)
        events.close()
        if node == "done":
            break
    assert nodes[0] == "classify_query" and "rewrite_query" in nodes and nodes[-1] == "done" and len(nodes) == len(set(nodes)) + 2  # two turns
    assert rows(table) == want
    assert rows(Engine(corpus, settings).ask(asked, log, "t")) == want  # a thread that ended gives its answers
    steps = log.history().orderBy("step").collect()
    assert [r.parent for r in steps] == [None, *range(len(steps) - 1)] and steps[-1].node == "done"
    later = Engine(corpus, settings)
    list(later.ask_iter(asked, log, "t"))
    assert later.cache.count() == 2  # the cache is part of the state
    assert log.compact("t") == len(steps) - 1 and log.history().count() == 1
    assert rows(log.latest("t").tables["out"]) == want and log.latest("other") is None


def test_one_failing_side_does_not_stop_the_other(spark, corpus, asked):
    class NoVectors(HashEmbedder):
        calls = 0

        def embed(self, text):
            NoVectors.calls += 1
            return super().embed(text) if NoVectors.calls == 1 else fails()

    engine = Engine(corpus, Settings(max_corrections=0), embedder=NoVectors())
    engine._remember = lambda _: None
    got = {r.query_id: r for r in engine.ask(asked).collect()}
    assert got[1].passed and "bm25" in got[1].answer
    status = {e[0]: (e[1], e[4]) for e in engine.events}
    assert status["retrieve_vector"] == ("failed", "ConnectionError") or ("retrieve_vector", "failed") in {(e[0], e[1]) for e in engine.events}
    assert status["retrieve_bm25"][0] == "done"
    trace = engine.trace(spark, "x").collect()
    assert [r.step for r in trace] == list(range(len(trace))) and any(r.status == "failed" and r.detail == "ConnectionError" for r in trace) and all(r.duration_ms >= 0 for r in trace)


@pytest.mark.parametrize("late", [False, True])
def test_failing_critics_and_generators_pass_nothing(corpus, asked, late):
    class NoCritic(Offline):
        def scores(self, query, answer, context):
            return [fails_late(query).cast("double")] * 3 if late else fails()

    class NoGenerator(Offline):
        def answer(self, query, best):
            return fails_late(query) if late else fails()

    got = Engine(corpus, Settings(max_corrections=0), provider=NoCritic()).ask(asked).collect()
    assert len(got) == 3 and all(not r.passed and r.faithfulness is None for r in got) and any("bm25" in r.answer for r in got)
    got = Engine(corpus, Settings(max_corrections=0), provider=NoGenerator()).ask(asked).collect()
    assert len(got) == 3 and all(not r.passed and r.answer is None for r in got)


def test_rerankers_and_checkpointers_are_called(spark, corpus, asked):
    class Shortest:
        def score(self, query, content):
            return -F.length(content).cast("double")

    class Broken:
        score = fails

    class Counted(SharedFolder):
        tags: list[str] = []

        def keep(self, df, tag):
            self.tags.append(tag)
            return super().keep(df, tag)

    one = asked.where("query_id = 2")
    got = Engine(corpus, Settings(max_corrections=0), reranker=Shortest(), checkpointer=Counted()).ask(one).first()
    assert got.answer == "filters spare shuffles"
    assert {"vectors", "classified", "reranked", "scored", "answers"} <= set(Counted.tags)
    engine = Engine(corpus, Settings(max_corrections=0), reranker=Broken())
    assert "bm25" in engine.ask(asked.where("query_id = 1")).first().answer
    assert ("rerank", "failed") in {(e[0], e[1]) for e in engine.events}


def test_progress_is_committed_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/events"
    schema = "session_id string, step int, node_name string, status string"
    assert sink.events(spark, path).collect() == []

    def run(checkpoint, *new):
        if new:
            spark.createDataFrame(list(new), schema).write.mode("append").parquet(source)
        sink.progress(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / checkpoint)).awaitTermination(120)
        return sorted((r.session_id, r.step, r.node_name, r.batch) for r in sink.events(spark, path).collect())

    assert run("cp", ("a", 0, "classify", "done"), ("b", 0, "classify", "done")) == [("a", 0, "classify", 0), ("b", 0, "classify", 0)]
    both = run("cp", ("a", 1, "answer", "failed"))
    assert both == [("a", 0, "classify", 0), ("a", 1, "answer", 1), ("b", 0, "classify", 0)]
    assert run("cp") == both
    assert run("lost checkpoint") == both  # batch 0 is there: what runs again adds nothing
    writer = sink.ProgressWriter(path, ["session_id", "step"])
    staged = [writer.write(iter([("x", 1)])), writer.write(iter([])), None]
    assert staged[1].file is None and run("cp") == both  # staged rows are not seen
    writer.abort(staged, 7)
    assert not (tmp_path / "events" / "events" / staged[0].file).exists()
    writer.commit([writer.write(iter([("x", 1)])), None], 8)
    assert ("x", 1, None, 8) in run("cp")
