"""Answers and vectors that are kept by content: who is asked what, and how often."""

import pytest
from pyspark.sql import functions as F

from quarry.sources.remembered import Remembered


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    return folder


def counted(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def vectors(folder):
    def model(texts):
        import uuid

        for t in texts:
            (folder / uuid.uuid4().hex).write_text(t)
        return [[float(len(t)), 1.0] for t in texts]

    return model


def test_equal_texts_are_asked_once_over_jobs(spark, tmp_path, log):
    kept = Remembered(spark, str(tmp_path / "r"), buckets=4)
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "  ")], "id int, text string").repartition(3)
    made = kept.embeddings(docs, "text", "m", vectors(log), 2)
    assert {r["id"]: r["embedding"] for r in made.collect()} == {1: [3.0, 1.0], 2: [3.0, 1.0], 3: [3.0, 1.0], 4: None, 5: None} and made.columns == ["id", "text", "embedding"]
    assert counted(log) == ["one", "two"]
    more = docs.union(spark.createDataFrame([(6, "three")], docs.schema))
    again = Remembered(spark, str(tmp_path / "r"), buckets=4).embeddings(more, "text", "m", vectors(log), 2)
    assert again.where("id = 6").first()["embedding"] == [5.0, 1.0] and again.count() == 6
    assert counted(log) == ["one", "three", "two"]
    kept.embeddings(docs, "text", "another", vectors(log), 2).count()  # vectors of two models aren't alike
    assert counted(log) == ["one", "one", "three", "two", "two"]


def test_old_entries_are_asked_again_and_forgotten(spark, tmp_path, log):
    kept = Remembered(spark, str(tmp_path / "r"), buckets=4, seconds=0)
    docs = spark.createDataFrame([(1, "one")], "id int, text string")
    kept.embeddings(docs, "text", "m", vectors(log), 2).count()
    Remembered(spark, str(tmp_path / "r"), buckets=4, seconds=3600).embeddings(docs, "text", "m", vectors(log), 2).count()
    assert counted(log) == ["one"]
    kept.embeddings(docs, "text", "m", vectors(log), 2).count()
    assert counted(log) == ["one", "one"]
    assert kept.forget(3600) == 0 and kept.forget(0) == 1 and kept.store.read().count() == 0


def test_failed_answers_are_not_kept(spark, tmp_path):
    kept = Remembered(spark, str(tmp_path / "r"), buckets=4)
    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, text string").repartition(2, F.col("id"))

    def failing(texts):
        if "bad" in texts:
            raise OSError("busy")
        return [t.upper() for t in texts]

    first = {r["id"]: r["answer"] for r in kept.answers(docs.where("id = 1"), "text", "m", failing, wait=0).collect()}
    assert first == {1: "GOOD"}
    assert kept.answers(docs.where("id = 2"), "text", "m", failing, wait=0).first()["answer"] is None
    assert {r["id"]: r["answer"] for r in kept.answers(docs, "text", "m", lambda texts: [t + "!" for t in texts], wait=0).collect()} == {1: "GOOD", 2: "bad!"}
