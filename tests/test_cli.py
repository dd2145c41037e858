"""The command line end to end on a small folder."""

import json

import pytest

from quarry import cli
from quarry.operators import ingest


def test_load_chunk_search(spark, tmp_path):
    docs = tmp_path / "docs" / "tutorial"
    docs.mkdir(parents=True)
    (docs / "a.md").write_text("# First Steps\n" + " ".join(f"This is sentence number {i} of it." for i in range(8)))
    args = lambda *a: cli.parser().parse_args(list(a))
    store, chunks = str(tmp_path / "store"), str(tmp_path / "chunks")
    assert json.loads(cli.run(args("load", str(docs), "--store", store), spark))["add"] == 1
    assert json.loads(cli.run(args("load", str(docs), "--store", store), spark))["skip"] == 1
    assert "a.md" in cli.run(args("chunk", str(docs), "--store", chunks), spark)
    found = json.loads(cli.run(args("search", "anything", "--store", chunks, "--format", "json"), spark).splitlines()[0])
    assert found["category"] == "tutorial" and found["content"].startswith("# First Steps")
    assert "tutorial" in cli.run(args("validate", str(docs)), spark) and cli.run(args("version"), spark) == "quarry 1"


def args(*a):
    return cli.parser().parse_args(list(a))


def prose(n, word="sentence"):
    return "# Title here\n" + " ".join(f"This is {word} number {i} of it." for i in range(n))


def test_chunk_skips_replaces_and_reports(spark, tmp_path):
    docs, store = tmp_path / "docs", str(tmp_path / "chunks")
    docs.mkdir()
    (docs / "a.md").write_text(prose(8))
    (docs / "b.md").write_text(prose(40, "other"))
    (docs / "blank.md").write_text(" \n")
    read = lambda: ingest.chunk_store(spark, store).read()
    first = cli.run(args("chunk", str(docs), "--store", store), spark)
    assert "empty document" in first and '"failed": 1' in first and '"successful": 2' in first
    before = sorted(map(str, read().select("file_path", "chunk_index", "content", "created_at").collect()))
    assert read().where("file_path like '%blank%'").count() == 0
    assert "skip" in cli.run(args("chunk", str(docs), "--store", store), spark)
    assert sorted(map(str, read().select("file_path", "chunk_index", "content", "created_at").collect())) == before
    (docs / "a.md").write_text(prose(9))
    cli.run(args("chunk", str(docs), "--store", store, "--dry-run"), spark)
    assert sorted(map(str, read().select("file_path", "chunk_index", "content", "created_at").collect())) == before
    assert "update" in cli.run(args("chunk", str(docs), "--store", store), spark)
    a = ingest.chunk_store(spark, store).rows_of(read().where("file_path like '%a.md'").first()["file_path"]).collect()
    assert [r["chunk_index"] for r in a] == list(range(len(a))) and "number 8" in a[-1]["content"] and a[0]["title"] == "Title here"
    assert sorted(str(r) for r in read().where("file_path like '%b.md'").select("file_path", "chunk_index", "content", "created_at").collect()) == [x for x in before if "b.md" in x]
    one = str(tmp_path / "whole")
    cli.run(args("chunk", str(docs), "--store", one, "--no-chunking"), spark)
    assert [(r["total_chunks"], r["avg_similarity"], r["embedding"]) for r in ingest.chunk_store(spark, one).read().collect()] == [(1, 0.0, [])] * 2


def test_load_keeps_a_store_it_cannot_read(spark, tmp_path):
    docs, store = tmp_path / "docs", tmp_path / "store"
    docs.mkdir()
    for k in range(3):
        (docs / f"doc{k}.md").write_text(f"text {k}")
    run = lambda *more: json.loads(cli.run(args("load", str(docs), "--store", str(store), *more), spark))
    assert run("--dry-run")["add"] == 3 and not store.exists()
    assert run()["add"] == 3 and run("--resume")["skip"] == 3 and run("--resume")["mode"] == "resume"
    (docs / "doc0.md").write_text("changed")
    (docs / "doc1.md").unlink()
    assert run()["update"] == 1 and run()["update"] == 1 and run()["delete"] == 1  # neither without its flag
    assert run("--update")["update"] == 1 and run()["update"] == 0
    assert run("--cleanup")["delete"] == 1 and run()["delete"] == 0 and run("--force")["skip"] == 2
    held = {p: p.read_bytes() for p in store.rglob("*") if p.is_file()}
    part = next(p for p in held if p.suffix == ".parquet" and "v-" in str(p) and p.parent.parent.name in (store / "manifest.json").read_text())
    part.write_bytes(b"broken")
    with pytest.raises(Exception):
        run("--update")
    assert part.read_bytes() == b"broken" and (store / "manifest.json").read_bytes() == held[store / "manifest.json"]
    foreign = tmp_path / "foreign"
    spark.range(3).write.parquet(str(foreign))
    with pytest.raises(ValueError):
        cli.run(args("load", str(docs), "--store", str(foreign)), spark)
    assert spark.read.parquet(str(foreign)).count() == 3


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    store = ingest.chunk_store(spark, str(tmp_path / "s"), buckets=4)
    docs = spark.createDataFrame([(f"f{k}", prose(6)) for k in range(5)], "file_path string, text string")
    assert {r["action"] for r in ingest.ingest(docs, store).collect()} == {"add"}
    broken = spark.createDataFrame([("f1", prose(7))], "file_path string, text string")

    def model(texts):
        raise ValueError("no model")

    with pytest.raises(Exception):
        ingest.ingest(broken, store, model=model)
    assert store.read().select("file_path").distinct().count() == 5
    assert {r["action"] for r in ingest.ingest(docs, store).collect()} == {"skip"}
    twice = ingest.ingest(broken.union(broken).union(spark.createDataFrame([("g", None)], broken.schema)), store).collect()
    assert sorted((r["file_path"], r["action"], r["error"]) for r in twice) == [("f1", "update", None), ("g", "error", "empty document")]
    assert store.vacuum() > 0 and store.read().select("file_path").distinct().count() == 5


def test_classify(spark):
    assert json.loads(cli.run(args("classify", "How do I configure the API?", "-m", "-v", "-f", "json"), spark))["intent"] == "howto"
    with pytest.raises(Exception):
        cli.run(args("classify", "unrelated words"), spark)
