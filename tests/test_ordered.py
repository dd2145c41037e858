"""Row numbers, greedy spacing, sliding percentiles and long documents against plain loops, with keys cut over many ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, monitoring, ordered, search
from quarry.operators.chunking import ChunkerConfig
from quarry.streaming import events


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def series(rng, n):
    """One key holds most rows, others a few; the null key counts as one."""
    return [(rng.choice(["hot"] * 6 + ["a", "b", None, f"k{k % 40}"]), rng.randint(0, 3 * n), k) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_numbers(spark, parts):
    rows = series(random.Random(parts), 400)
    df = spark.createDataFrame(rows, "key string, at long, id int").repartition(5)
    made = ordered.numbered(df, [F.col("at").asc(), F.col("id").asc()], ["key"], "n", parts).collect()
    of = {}
    for k, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        of.setdefault(k, []).append(i)
    assert {r["id"]: r["n"] for r in made} == {i: n + 1 for ids in of.values() for n, i in enumerate(ids)}
    whole = ordered.numbered(df, [F.col("at").desc(), F.col("id").asc()], [], "n", parts)
    assert [r["id"] for r in sorted(whole.collect(), key=lambda r: r["n"])] == [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    assert "SinglePartition" not in plan(whole) and ordered.numbered(df.limit(0), [F.col("at").asc()], ["key"]).collect() == []


def fold(rows, gap):
    last, out = {}, []
    for k, at, i in sorted(rows, key=lambda r: r[1]):
        if k not in last or at - last[k] >= gap:
            out.append((str(k), at, last.get(k)))
            last[k] = at
    return sorted(out, key=str)


@pytest.mark.parametrize("parts, gap", [(1, 5), (4, 5), (9, 1), (9, 40), (9, 2000), (13, 333), (5, 10**9)])
def test_spacing_is_the_fold(spark, parts, gap):
    rows = series(random.Random(gap), 500)
    df = spark.createDataFrame(rows, "key string, at long, id int").repartition(3)
    made = ordered.spaced(df, ["key"], "at", gap, parts, lead="before").collect()
    assert sorted(((str(r["key"]), r["at"], r["before"]) for r in made), key=str) == fold(rows, gap)


def test_spacing_without_gap_and_without_rows(spark):
    rows = series(random.Random(1), 60)
    df = spark.createDataFrame(rows, "key string, at long, id int")
    assert ordered.spaced(df, ["key"], "at", 0, 4).count() == 60 and ordered.spaced(df.limit(0), ["key"], "at", 9).count() == 0
    with pytest.raises(ValueError):
        ordered.spaced(df, ["key"], "at", -1)


def test_state_maps_compose():
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(0, 4000, 600))
    for gap in (1, 7, 90, 5000):
        maps = [ordered.state_map(p, gap) for p in np.array_split(at, 8)]
        assert all(len(e) <= (p <= p[0] + gap).sum() + 1 for (e, _), p in zip(maps, np.array_split(at, 8)))
        state = None
        for e, x in maps:
            state = ordered.entered(state, e, x, gap)
        assert state == max(t for _, t, _ in fold([("k", int(t), 0) for t in at], gap))


def test_cooldown_in_batch(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["r", "r", "r", "s"]), 1_700_000_000 + rng.randint(0, 20_000) + rng.choice([0.0, 0.25]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "repository string, s double, id int").select("repository", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "id")
    made = events.cooled_batch(df, parts=6).select("repository", F.col("ts").cast("double").alias("s")).collect()
    assert sorted((r["repository"], r["s"]) for r in made) == sorted((k, t) for k, t, _ in fold(rows, 600))
    assert set(events.cooled_batch(df).columns) == set(df.columns)


def nearest(values, share):
    return sorted(values)[int(np.floor(share * (len(values) - 1) + 0.5))] if values else None


@pytest.mark.parametrize("window", [1, 5, 64])
def test_sliding_percentiles(spark, window):
    rng = random.Random(window)
    rows = [(rng.choice(["a", "a", "a", "b"]), k, rng.choice([None, *[float(rng.randint(0, 30)) for _ in range(8)]])) for k in range(350)]
    df = spark.createDataFrame(rows, "by string, at long, ms double").repartition(4)
    made = ordered.sliding(df, [F.col("at").asc()], "ms", {"p50": 0.5, "p99": 0.99}, ["by"], window, block=70, parts=5).collect()
    of = {k: [v for b, _, v in rows if b == k] for k in ("a", "b")}
    place = {k: 0 for k in of}
    want = {}
    for b, at, _ in rows:
        held = [v for v in of[b][max(0, place[b] - window + 1) : place[b] + 1] if v is not None]
        want[at] = (nearest(held, 0.5), nearest(held, 0.99))
        place[b] += 1
    assert {r["at"]: (r["p50"], r["p99"]) for r in made} == want and len(made) == 350
    again = monitoring.sliding_percentiles(df, "by", ["at"], window=window)
    assert {r["at"]: (r["p50"], r["p99"]) for r in again.collect()} == want and again.columns == ["by", "at", "p50", "p95", "p99"]


def test_deliveries(spark):
    df = spark.range(1, 96).select("id", F.pmod(F.xxhash64("id"), F.lit(7)).alias("score")).repartition(6)
    made = search.batches(df, 10, F.desc("score"), F.asc("id"))
    rows = sorted(made.collect(), key=lambda r: (-r["score"], r["id"]))
    assert [r["batch"] for r in rows] == [k // 10 for k in range(95)] and [r["has_more"] for r in rows] == [k < 90 for k in range(95)]
    assert "SinglePartition" not in plan(made).split("Adaptive")[0] or "Window" not in plan(made)


@pytest.mark.parametrize("mode", ["stored", "whole"])
@pytest.mark.parametrize("seed", range(3))
def test_long_documents_are_chunked_alike(spark, mode, seed, monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK", 8)
    monkeypatch.setattr(ordered, "ROWS", 20)  # a document lies in many ranges
    rng = random.Random(seed)
    low = rng.randint(1, 4)
    config = ChunkerConfig(rng.choice([0.2, 0.7]), low, low + rng.randint(0, 6), rng.choice([0.3, 0.5, 0.9]), mode=mode)
    rows = []
    for doc, n in ((1, 1), (2, 2), (3, 9), (4, 60), (5, 150), (None, 7)):
        v = [rng.gauss(0, 1) for _ in range(3)]
        for k in range(n):
            if rng.random() < 0.3:
                v = [rng.gauss(0, 1) for _ in range(3)]
            rows.append((doc, k, f"sentence {k} of {doc}", [0.0] * 3 if rng.random() < 0.02 else [x + rng.gauss(0, 0.2) for x in v]))
    df = spark.createDataFrame(rows, "doc_id int, number int, sentence string, embedding array<float>").repartition(3)
    plain = lambda made: sorted(str((r["doc_id"], r["chunk_index"], r["total_chunks"], r["start_sentence"], r["end_sentence"], r["content"], [round(x, 9) for x in r["embedding"]], round(r["avg_similarity"], 9) if r["avg_similarity"] is not None else None, r["word_count"], r["char_count"])) for r in made.where("doc_id is not null").collect())
    assert plain(chunking.chunked_long(df.where("doc_id is not null"), config)) == plain(chunking.chunked(df, config))


@pytest.mark.parametrize("mode", ["stored", "whole"])
def test_spans_of_a_stream_are_those_of_a_row(spark, mode):
    rng = random.Random(6)
    config = ChunkerConfig(0.7, 3, 7, mode=mode)
    rows = [(k, sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n) for k, n in enumerate(rng.randint(1, 60) for _ in range(200))]
    made = spark.createDataFrame(rows, "k int, cuts array<int>, n int").select("k", chunking.spans(F.concat(F.array(F.lit(0)), "cuts"), F.col("n"), config).alias("s")).collect()
    assert all([tuple(x) for x in r["s"]] == chunking.spans_of(*rows[r["k"]][1:], config) for r in made)


def test_sentences_are_chunked_as_a_stream(spark):
    """No row of all vectors, no window and no higher-order function over components; batches may cut a document anywhere."""
    rows = [(d, k, f"sentence {k} of {d}", [float((d * 7 + k * k) % 5 + 1), float(k % 3), 1.0]) for d in range(5) for k in range(1 if d == 2 else 40)]
    df = spark.createDataFrame(rows, "doc_id int, number int, sentence string, embedding array<float>")
    made, long = chunking.chunked(df), chunking.chunked_long(df)
    for p in (plan(made), plan(long)):
        assert "MapInArrow" in p and not any(x in p for x in ("collect_list", "Window", "zip_with"))
    whole = sorted(map(str, made.collect()))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert sorted(map(str, chunking.chunked(df).collect())) == whole == sorted(map(str, chunking.chunked_long(df).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_chunks_in_the_row_and_by_sentence_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    key = lambda made: sorted(str(tuple(r)) for r in made.drop("embedding").withColumn("avg_similarity", F.round("avg_similarity", 9)).collect())
    one = key(chunking.chunk_documents(docs, size=64))
    assert one == key(chunking.chunk_documents(docs, size=64, long=True)) and len(one) > 30
