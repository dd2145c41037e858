"""The store's log: several writers, lost entries, older versions, deletes with counts, what a vacuum leaves."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, ingest
from quarry.sources.store import Conflict, Store

SCHEMA = "file_path string, n int"


def rows(spark, *keys, n=0):
    return spark.createDataFrame([(k, n) for k in keys], SCHEMA)


def content(store, **kw):
    return sorted(tuple(r) for r in store.read(**kw).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), SCHEMA, buckets=8)


def buckets_of(store, spark, keys):
    made = spark.createDataFrame([(k,) for k in keys], "file_path string")
    return {r[0]: r[1] for r in made.select("file_path", store.bucket(made["file_path"], 8)).collect()}


def test_versions_and_counts(spark, store):
    assert store.manifest()["version"] == 0 and content(store) == []
    first = store.replace(rows(spark, "a", "b", "c"))
    second = store.replace(rows(spark, "b", n=5), rows(spark, "c", "unknown"))
    assert (first.version, first.added, first.deleted) == (1, 3, 0) and (second.version, second.added, second.deleted) == (2, 1, 2)
    assert content(store) == [("a", 0), ("b", 5)] and content(store, version=1) == [("a", 0), ("b", 0), ("c", 0)]
    assert store.delete(rows(spark, "a", "zz")) == 1 and store.delete(rows(spark, "zz")) == 0
    assert store.replace(rows(spark)).version == 4 and store.versions() == [1, 2, 3, 4]
    assert content(store) == [("b", 5)]
    with pytest.raises(ValueError):
        store.read(version=9)


def test_vacuum_keeps_what_is_named(spark, store, tmp_path):
    for n in range(4):
        store.replace(rows(spark, "a", "b", "c", "d", n=n))
    older = content(store, version=3)
    assert store.vacuum(keep=2) > 0 and content(store, version=3) == older and store.versions() == [3, 4]
    assert store.vacuum() > 0 and store.vacuum() == 0 and content(store) == [(k, 3) for k in "abcd"] and store.versions() == [4]
    store.replace(rows(spark, "e", n=9))
    assert ("e", 9) in content(store)
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_") and p.name != "_log"]


def test_two_writers_on_one_state(spark, store):
    """Commits decided on the same version: other buckets are both kept, the same ones are refused."""
    store.replace(rows(spark, *"abcdefgh"))
    at = buckets_of(store, spark, "abcdefgh")
    apart = next((x, y) for x in "abcdefgh" for y in "abcdefgh" if at[x] != at[y])
    base = store.manifest()
    store.replace(rows(spark, apart[0], n=1), base=base)
    store.replace(rows(spark, apart[1], n=2), base=base)
    held = dict(content(store))
    assert held[apart[0]] == 1 and held[apart[1]] == 2 and len(held) == 8
    before = content(store)
    with pytest.raises(Conflict):
        store.replace(rows(spark, apart[0], n=3), base=base)
    assert content(store) == before


def test_writers_at_once(spark, store):
    store.replace(rows(spark, "first"))
    done, refused = [], []

    def write(k):
        try:
            done.append((k, store.replace(rows(spark, f"k{k}", n=k)).version))
        except Conflict:
            refused.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) + len(refused) == 6 and done
    assert {v for _, v in done} == set(range(2, 2 + len(done)))  # every version was given once
    assert content(store) == sorted([("first", 0), *((f"k{k}", k) for k, _ in done)])


def test_an_entry_is_made_once(spark, store, tmp_path):
    store.replace(rows(spark, "a"))
    file = f"{store.path}/_log/{7:020d}.json"
    made = []
    threads = [threading.Thread(target=lambda k=k: made.append(store._create(file, {"by": k}))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [False] * 7 + [True]


def test_lost_parts_are_errors(spark, store, tmp_path):
    store.replace(rows(spark, "a"))
    store.replace(rows(spark, "b"))
    home = tmp_path / "s"
    log = sorted((home / "_log").glob("0*.json"))
    kept = log[-1].read_bytes()
    log[-1].unlink()
    for attempt in (store.read, lambda: store.replace(rows(spark, "c")), store.vacuum):  # the head
        with pytest.raises(ValueError, match="lost"):
            attempt()
    log[-1].write_bytes(kept)
    (home / "manifest.json").unlink()  # only a copy
    assert content(store) == [("a", 0), ("b", 0)]
    store.replace(rows(spark, "c"))
    assert json.loads((home / "manifest.json").read_text())["version"] == 3
    log[1].unlink()
    with pytest.raises(ValueError, match="gaps"):
        store.read()


def test_lost_log_and_manifest(spark, store, tmp_path):
    store.replace(rows(spark, "a", "b"))
    home = tmp_path / "s"
    for p in [*(home / "_log").iterdir(), home / "manifest.json"]:
        p.unlink()
    for attempt in (store.read, lambda: store.replace(rows(spark, "c")), store.vacuum):
        with pytest.raises(ValueError):
            attempt()
    assert [p for p in home.iterdir() if p.name.startswith("v-")]


def test_a_failed_first_commit_is_no_store_yet(spark, store, tmp_path):
    broken = spark.range(1).selectExpr("'a' AS file_path", "cast(raise_error('broken') AS int) AS n")
    with pytest.raises(Exception, match="broken"):
        store.replace(broken)
    (tmp_path / "s" / "v-left").mkdir(parents=True, exist_ok=True)
    assert content(store) == [] and store.replace(rows(spark, "a")).version == 1


def test_ingest_with_chunks_and_a_source_that_changes(spark, tmp_path):
    prose = " ".join(f"This is sentence number {k} about things." for k in range(12))
    store = ingest.chunk_store(spark, str(tmp_path / "c"), buckets=4)
    docs = spark.createDataFrame([(f"f{k}.md", prose + f" The end of text {k} comes here.") for k in range(4)] + [("blank.md", " ")], "file_path string, text string")
    source = str(tmp_path / "source")
    docs.write.parquet(source)
    config = chunking.ChunkerConfig(min_chunk_sentences=2, max_chunk_sentences=4)
    report = ingest.ingest(spark.read.parquet(source), store, config)
    docs.limit(0).write.mode("overwrite").parquet(source)  # the report doesn't read the source again
    made = {r["file_path"]: r for r in report.collect()}
    assert {r["action"] for r in made.values()} == {"add", "error"} and made["blank.md"]["chunks_created"] == 0
    held = store.read().groupBy("file_path").count().collect()
    assert {r["file_path"]: r["count"] for r in held} == {p: r["chunks_created"] for p, r in made.items() if r["chunks_created"]}
    want = chunking.chunk_documents(docs.where("file_path <> 'blank.md'"), config, key="file_path")
    both = lambda df: sorted((r["file_path"], r["chunk_index"], r["content"], r["total_chunks"]) for r in df.collect())
    assert both(store.read()) == both(want)
    assert not [p.name for p in (tmp_path / "c").iterdir() if p.name.startswith(("_report", "_staged"))]


def test_a_bucket_is_many_tasks(spark, tmp_path, monkeypatch):
    """A task that writes reads so many rows, not a whole bucket; a key stays in one file."""
    from quarry.sources import store as module

    monkeypatch.setattr(module, "ROWS", 20)
    kept = Store(spark, str(tmp_path / "t"), "file_path string, k int", "file_path", ("k",), buckets=2)
    rows = spark.createDataFrame([(f"f{j // 2}", j) for j in range(400)], "file_path string, k int")
    assert kept.replace(rows).added == 400
    files = kept.read().select(F.input_file_name().alias("f"), "file_path").distinct().collect()
    assert len({r["f"] for r in files}) > 8 and len(files) == 200
    assert kept.delete(rows.where("k < 100").select("file_path")) == 100 and kept.read().count() == 300
    assert [r["k"] for r in kept.rows_of("f70").collect()] == [140, 141]
