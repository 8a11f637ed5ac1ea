"""Keyed answer state over a stream: hits, expiry, restarts."""

from datetime import datetime, timedelta

from tessera.streaming import answers

SCHEMA = "cache_key string, seq long, at timestamp, kind string, answer string"


def test_hits_expiry_and_restart(spark, tmp_path):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def feed(*rows):
        """Each call is a run of its own that starts from the checkpoint."""
        spark.createDataFrame([(k, n, at(s), kind, a) for k, n, s, kind, a in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        answers.run(answers.answers(spark.readStream.schema(SCHEMA).parquet(source), 60), out, checkpoint)
        return {(r.cache_key, r.seq): (r.kind, r.hit, r.answer, r.hit_count) for r in spark.read.parquet(out).collect()}

    got = feed(("a", 3, 20, "get", None), ("a", 2, 10, "get", None), ("a", 1, 0, "put", "A"), ("b", 4, 20, "get", None))
    assert got == {("a", 2): ("get", True, "A", 1), ("a", 3): ("get", True, "A", 2), ("b", 4): ("get", False, None, None)}
    got = feed(("a", 5, 59, "get", None), ("b", 6, 100, "put", "B"), ("b", 7, 90, "put", "older"))
    assert got["a", 5] == ("get", True, "A", 3) and got["a", None] == ("expired", None, "A", 3)  # counted on after the restart
    got = feed(("a", 8, 101, "get", None), ("b", 9, 110, "get", None), ("b", 10, 120, "put", "B2"), ("b", 11, 170, "get", None), (None, 12, 171, "get", None))
    assert got["a", 8] == ("get", False, None, None) and got["b", 9] == ("get", True, "B", 1) and got["b", 11] == ("get", True, "B2", 1) and got[None, 12][1] is False
    got = feed(("c", 13, 400, "get", None))
    assert got["b", None] == ("expired", None, "B2", 1)
    assert len(got) == 11
