"""Kept aggregates against the events themselves; delivery once, with batches that are replayed."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quarry.operators import analytics
from quarry.operators.rollups import UsageRollups
from quarry.streaming.ledger import Ledger, fan_out

SCHEMA = (
    "type string, query_id long, session_id string, user_id string, query string, query_type string, result_count long, execution_time_ms long, zero_results boolean,"
    " position long, time_to_click_ms long, duration_ms long, ts timestamp"
)


def events(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.choice(["query"] * 5 + ["click"] * 2 + ["session_end"])
        results = rng.choice([None, 0, 0, 3, 7, 12])
        rows.append((kind, rng.randint(0, n // 2), rng.choice([None, *[f"s{k % 97}"] * 5]), rng.choice([None, *[f"u{k % 61}"] * 5]), rng.choice([None, "a", "b", "c d", f"rare {k}"]), rng.choice([None, "simple", "advanced"]), results, rng.choice([None, rng.randint(1, 900)]), results == 0, rng.choice([None, rng.randint(0, 9)]), rng.choice([None, rng.randint(0, 5000)]), rng.randint(0, 10**6), rng.randint(0, 86_400 * 3)))
    df = spark.createDataFrame([(*r[:-1], None if r[-1] % 50 == 0 else r[-1]) for r in rows], SCHEMA.replace("ts timestamp", "s long"))
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_735_689_600)).drop("s").cache()


def close(made, want, tolerance):
    return abs(made - want) <= max(1, tolerance * want)


def agree(kept, all_, start=None, end=None):
    held = all_.where("ts is not null")
    held = held if start is None else held.where(F.col("ts").between(start, end))
    u, w = kept.usage(start, end).first(), analytics.usage(held).first()
    assert (u["total_queries"], u["zero_result_queries"]) == (w["total_queries"], w["zero_result_queries"])
    asked = held.where("type = 'query'")
    means = asked.agg((F.sum("result_count") / F.count("*")).alias("r"), F.avg("execution_time_ms").alias("e")).first()
    assert u["avg_results"] == pytest.approx(means["r"] or 0) and u["avg_execution_ms"] == pytest.approx(means["e"] or 0)
    assert close(u["unique_sessions"], w["unique_sessions"], 0.06) and close(u["unique_users"], w["unique_users"], 0.06)
    times = sorted(r[0] for r in asked.where("execution_time_ms is not null").select("execution_time_ms").collect())
    for p, v in ((0.5, u["p50_ms"]), (0.95, u["p95_ms"])):
        if times:
            low, high = sum(t < v for t in times) / len(times), sum(t <= v for t in times) / len(times)
            assert low - 0.03 <= p <= high + 0.03
    texts = asked.groupBy(F.coalesce("query", F.lit("")).alias("query")).count().orderBy(F.desc("count"), "query").limit(4).collect()
    assert [(r["query"], r["count"]) for r in kept.popular(4, start, end).collect()] == [tuple(r) for r in texts]
    types = {r[0]: r[1] for r in asked.groupBy(F.coalesce("query_type", F.lit(""))).count().collect()}
    assert {r[0]: r[1] for r in kept.by_type(start, end).collect()} == types
    q, x = kept.quality(start, end).first(), analytics.quality(held).first()
    for name in ("queries", "clicks", "avg_click_position", "avg_time_to_click_ms", "avg_session_ms", "click_through_rate"):
        assert q[name] == pytest.approx(x[name]), name
    assert q["relevance"] == pytest.approx(x["relevance"], abs=0.03)


def test_increments_compaction_and_periods(spark, tmp_path):
    all_ = events(spark, 3000, 1)
    kept = UsageRollups(spark, str(tmp_path / "u"))
    assert kept.usage().first()["total_queries"] == 0 and kept.popular().collect() == []
    parts = all_.randomSplit([1.0, 1.0, 1.0], 3)  # late events in every part
    for k, p in enumerate(parts):
        assert kept.put(p, k)
        assert not kept.put(p, k)  # the same batch again
    agree(kept, all_)
    lines = {r["line"].split()[0]: int(r["line"].split()[1]) for r in kept.exposition().collect()}
    assert lines["search_queries_total"] == all_.where("type = 'query' and ts is not null").count()
    start, end = F.lit("2025-01-01 05:00:00").cast("timestamp"), F.lit("2025-01-02 17:59:59.999999").cast("timestamp")
    agree(kept, all_, start, end)
    kept.compact()
    assert len(kept.ledger.manifest()["folders"]) == 1
    agree(kept, all_)
    agree(kept, all_, start, end)
    assert not kept.put(parts[0], 2) and kept.put(parts[0], 3)
    by_hour = kept.usage(None, None, "hour").collect()
    assert sum(r["total_queries"] for r in by_hour) == kept.usage().first()["total_queries"] and len(by_hour) > 60


def test_events_are_not_read_again(spark, tmp_path):
    all_, kept = events(spark, 400, 2), UsageRollups(spark, str(tmp_path / "u"))
    source = str(tmp_path / "events")
    all_.write.parquet(source)
    kept.put(spark.read.parquet(source), 0)
    made = kept.usage(F.lit("2025-01-01").cast("timestamp"), F.lit("2025-01-03").cast("timestamp"))
    assert all(source not in f for f in made.inputFiles())
    text = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(kind,all)" in text and "GreaterThanOrEqual(hour" in text


def test_a_replayed_batch_delivers_nothing_twice(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), "id long, batch long")
    rows = lambda k: spark.range(3).selectExpr("id", f"{k}L AS batch")
    assert ledger.write(rows(0), 0) and ledger.write(rows(1), 1)
    assert not ledger.write(rows(1), 1) and not ledger.write(rows(0), 0) and ledger.write(rows(0), 0, "another")
    done = []
    threads = [threading.Thread(target=lambda: done.append(ledger.write(rows(2), 2))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [False, False, True]
    assert sorted(r["batch"] for r in ledger.read().collect()) == [0] * 6 + [1] * 3 + [2] * 3

    class Broken(Ledger):
        def add(self, state, folder=None):
            raise OSError("lost between the rows and the entry")

    with pytest.raises(OSError):
        Broken(spark, str(tmp_path / "l"), "id long, batch long").write(rows(3), 3)
    assert ledger.read().count() == 12 and ledger.write(rows(3), 3) and ledger.read().count() == 15


def test_stream_that_starts_again(spark, tmp_path):
    """The checkpoint forgets its last commit, as after a failure between a batch and its commit: the batch comes again."""
    source, home, check = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "check"
    schema = "document_id string, category string, repository string, tags array<string>"
    subs = spark.createDataFrame([("c1", 1, ["a"], None, None, None), ("c2", 2, None, None, None, ["t"])], "conn_id string, sub_id int, categories array<string>, repositories array<string>, document_ids array<string>, tags array<string>")
    ledger = Ledger(spark, home, f"conn_id string, sub_id int, {schema}")
    spark.createDataFrame([("d1", "a", None, ["t"]), ("d2", "b", "r", None)], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    fan_out(ledger, stream(), subs, str(check)).awaitTermination(120)
    want = [("c1", "d1"), ("c2", "d1")]
    held = lambda: sorted((r["conn_id"], r["document_id"]) for r in ledger.read().collect())
    assert held() == want
    for f in (check / "commits").iterdir():
        f.unlink()
    fan_out(ledger, stream(), subs, str(check)).awaitTermination(120)
    assert held() == want
    spark.createDataFrame([("d3", "a", None, None)], schema).write.mode("append").parquet(source)
    fan_out(ledger, stream(), subs, str(check)).awaitTermination(120)
    assert held() == sorted([*want, ("c1", "d3")])
