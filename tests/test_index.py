"""The inverted index against scans of the documents: any order of puts, updates, removals and merges."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from quarry.sources import index as ix
from quarry.sources.index import TextIndex

WORDS = ["stone", "river", "light", "garden", "walk", "under", "house", "größe", "paper", "rare"]


def texts(rng, ids):
    return {i: " ".join(rng.choices(WORDS[:9], k=rng.randint(0, 12)) + (["rare"] if rng.random() < 0.05 else [])) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")


def holding(docs, terms, any_of=False):
    test = any if any_of else all
    return sorted(i for i, t in docs.items() if terms and test(w in t.split() for w in terms))


def bm25(docs, terms, k):
    n, mean = len(docs), sum(len(t.split()) for t in docs.values()) / max(len(docs), 1)
    df = {w: sum(w in t.split() for t in docs.values()) for w in terms}
    out = []
    for i, t in docs.items():
        words = t.split()
        score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (c := words.count(w)) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w in terms if w in words)
        if any(w in words for w in terms):
            out.append((-round(score, 9), i))
    return sorted(out)[:k]


ASKED = [["stone"], ["stone", "river"], ["rare", "light", "größe"], ["absent"], ["stone", "absent"], []]


def check(index, docs):
    state = index.manifest()
    assert (state["documents"], state["length"]) == (len(docs), sum(len(t.split()) for t in docs.values()))
    for terms in ASKED:
        for any_of in (False, True):
            assert sorted(r[0] for r in index.holding(terms, any_of).collect()) == holding(docs, terms, any_of), terms
    for terms in (["stone", "river"], ["rare"]):
        made = index.ranked(terms, 7).collect()
        assert [(-round(r["score"], 9), r["doc"]) for r in made] == bm25(docs, terms, 7) and [r["rank"] for r in made] == list(range(1, len(made) + 1))


def test_equals_a_scan_through_its_life(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "RANGE", 16)  # many blocks
    rng, docs = random.Random(5), {}
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    check(index, docs)
    ids = [*range(40), -7, 1 << 40]
    first = texts(rng, ids)
    index.put(frame(spark, first))
    docs |= first
    check(index, docs)
    again = texts(rng, [*range(0, 40, 3), 100, 101])  # updates and new ones
    index.put(frame(spark, again), removed=frame(spark, {5: "", 6: "", 999: ""}))
    docs = {i: t for i, t in docs.items() if i not in (5, 6)} | again
    check(index, docs)
    older = dict(docs)
    at = index.manifest()["version"]
    index.remove(frame(spark, {0: "", 101: ""}))
    docs = {i: t for i, t in docs.items() if i not in (0, 101)}
    check(index, docs)
    assert sorted(r[0] for r in index.holding(["stone"], version=at).collect()) == holding(older, ["stone"])
    index.merge()
    check(index, docs)
    assert len(index.manifest()["segments"]) == 1
    late = texts(rng, [3, 5, 200])
    index.put(frame(spark, late))
    docs |= late
    assert index.vacuum() > 0
    check(index, docs)
    counts = {r["term"]: (r["documents"], r["occurrences"]) for r in index.terms().collect()}
    assert counts == {w: (sum(w in t.split() for t in docs.values()), sum(t.split().count(w) for t in docs.values())) for w in WORDS if any(w in t.split() for t in docs.values())}


def test_reads_the_terms_buckets_only(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=16)
    index.put(frame(spark, texts(random.Random(1), range(300))))
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    made = index.holding(["stone", "river"])
    files = made.inputFiles()
    folders = {f.split("bucket=")[1].split("/")[0] for f in files}
    want = {str(r[0]) for r in spark.createDataFrame([("stone",), ("river",)], "t string").select(index._bucket(F.col("t"), 16)).collect()}
    assert folders == want and all("postings" in f for f in files)
    text = plan(made)
    assert "PushedFilters: [In(term, [river,stone])]" in text or "In(term" in text
    assert "counts" not in text.split("ReadSchema")[1].split("\n")[0]  # ranking's columns aren't read


def test_rows_that_repeat_null_and_long(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    rows = [(1, "one two"), (1, "one two three"), (1, "one two three"), (None, "lost"), (2, None), (3, ""), (4, "word " * 200_000 + "end")]
    index.put(spark.createDataFrame(rows, "doc_id long, text string"))
    assert index.manifest()["documents"] == 4 and index.manifest()["length"] == 3 + 200_001
    assert [r[0] for r in index.holding(["three"]).collect()] == [1] and index.holding(["lost"]).count() == 0
    assert [(r["doc"], r["rank"]) for r in index.ranked(["end", "word"], every=True).collect()] == [(4, 1)]


def test_keywords(spark, tmp_path):
    rows = [(1, ["a b", "c"]), (2, ["c", None]), (3, None), (4, [])]
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.put(spark.createDataFrame(rows, "doc_id long, keywords array<string>"), terms=F.col("keywords"))
    assert sorted(r[0] for r in index.holding(["c"]).collect()) == [1, 2] and [r[0] for r in index.holding(["a b", "c"]).collect()] == [1]


def test_two_writers_and_a_merge(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    rng = random.Random(2)
    docs = texts(rng, range(20))
    index.put(frame(spark, docs))
    index.put(frame(spark, more := texts(rng, range(10, 30))))
    docs |= more
    parts = [texts(rng, range(100 * k, 100 * k + 8)) for k in (1, 2, 3)]
    jobs = [threading.Thread(target=lambda p=p: index.put(frame(spark, p))) for p in parts] + [threading.Thread(target=index.merge)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    for p in parts:
        docs |= p
    check(index, docs)


def test_lost_entry(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.put(frame(spark, {1: "a"}))
    index.put(frame(spark, {2: "a"}))
    sorted((tmp_path / "i" / "_log").glob("0*.json"))[-1].unlink()
    with pytest.raises(ValueError, match="lost"):
        index.holding(["a"])


def test_postings_are_laid_as_a_stream(spark, tmp_path, monkeypatch):
    """Words of a document are counted where it lies, and blocks built of sorted rows: no lists are collected, no JSON is made of texts, batches may cut a block."""
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().toString()), write(self, *a, **k))[1])
    monkeypatch.setattr(ix, "RANGE", 16)
    docs = {k: " ".join(["hot"] * (k % 3 + 1) + [f"w{k % 7}"]) for k in range(100)}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        index = TextIndex(spark, str(tmp_path / "i"), buckets=3)
        index.put(frame(spark, docs))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert plans and not any(x in p for p in plans for x in ("collect_list", "to_json"))
    blocks = spark.read.schema(ix.POSTINGS).parquet(f"{index.path}/{index.manifest()['segments'][0]['folder']}/postings").where("term = 'hot'").collect()
    assert sorted((b["first"], b["n"]) for b in blocks) == [(k, min(16, 100 - k)) for k in range(0, 100, 16)]
    assert all(b["counts"] == [(b["first"] + o) % 3 + 1 for o in b["docs"]] and b["sizes"] == [c + 1 for c in b["counts"]] for b in blocks)
    assert {(r["term"], r["documents"], r["occurrences"]) for r in index.terms().collect()} == {("hot", 100, 199), *((f"w{k}", len(range(k, 100, 7)), len(range(k, 100, 7))) for k in range(7))}
