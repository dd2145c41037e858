"""Streams driven to their end from files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.streaming import events as ev

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_change_state_and_cooldown(spark, tmp_path):
    rows = [("r", "c1", T0), ("r", "c1", T0 + timedelta(minutes=1)), ("r", "c2", T0 + timedelta(minutes=2))]
    made = drained(spark, ev.changed(stream(spark, tmp_path, rows, "repository string, commit string, ts timestamp")), "changed").orderBy("ts").collect()
    assert [(r["kind"], r["before"], r["after"]) for r in made] == [("baseline", None, "c1"), ("change", "c1", "c2")]
    times = [("r", T0 + timedelta(seconds=s)) for s in (0, 300, 599, 601, 900, 1300)]
    made = drained(spark, ev.cooled(stream(spark, tmp_path / "x", times, "repository string, ts timestamp")), "cooled").orderBy("ts").collect()
    assert [(r["ts"] - T0).seconds for r in made] == [0, 601, 1300]


def test_windows(spark, tmp_path):
    schema = "type string, session_id string, user_id string, zero_results boolean, result_count long, execution_time_ms long, ts timestamp"
    rows = [("query", "s", "u", False, 4, 10, T0 + timedelta(minutes=m)) for m in (0, 10, 70)]
    made = drained(spark, ev.windowed_usage(stream(spark, tmp_path, rows, schema)), "windows", "complete").orderBy("start").collect()
    assert [(r["total_queries"], r["avg_results"]) for r in made] == [(2, 4.0), (1, 4.0)]


def test_delivery(spark):
    updates = spark.createDataFrame([("d1", "tutorial", "r1", ["x"]), ("d2", "reference", None, [])], "document_id string, category string, repository string, tags array<string>")
    subs = spark.createDataFrame([("c", "all", None, None, None, None), ("c", "cat", ["tutorial"], None, None, None), ("c", "repo", None, ["r1"], None, None), ("c", "tag", None, None, ["x"], None)], "conn_id string, sub_id string, categories array<string>, repositories array<string>, tags array<string>, document_ids array<string>")
    got = sorted((r["sub_id"], r["document_id"]) for r in ev.delivered(updates, subs).collect())
    assert got == [("all", "d1"), ("all", "d2"), ("cat", "d1"), ("repo", "d1"), ("tag", "d1")]


def test_collected(spark, tmp_path):
    q = ev.collected(stream(spark, tmp_path, [(1, T0), (2, T0)], "id long, ts timestamp"), str(tmp_path / "out"), str(tmp_path / "cp"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("id")).first()[0] == 3


def test_polls_follow_commands(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    signals = [("r", "tick", 0), ("r", "pause", 1), ("r", "tick", 5), ("r", "check", 6), ("r", "resume", 7), ("r", "tick", 10), ("r", "stop", 11), ("r", "tick", 15), ("r", "check", 16), ("s", "tick", 5), ("s", "pause", 5), ("s", "tick", 6)]
    rows = [(k, c, at(m)) for k, c, m in signals]
    made = drained(spark, ev.polls(stream(spark, tmp_path, rows, "repository string, command string, ts timestamp")), "polls", "append").collect()
    assert sorted((r["repository"], (r["ts"] - T0).seconds // 60, r["by"]) for r in made) == [("r", 0, "tick"), ("r", 6, "check"), ("r", 10, "tick"), ("s", 5, "tick")]
