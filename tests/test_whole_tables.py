"""Queries that have to work on all rows of their tables, on small fixtures."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions.vector import cosine
from quarry.operators import search
from quarry.plans.queries import QUERIES, SQL


def test_code_structure_reads_every_document_in_every_language(spark, tmp_path):
    texts = {0: "one\ntwo", 1: "three", 2: "", 3: "four", 4: "five", 5: "six", 6: "seven\n\neight", 7: None, 8: "nine", 9: "ten", 10: "x", 11: "y", 13: "z"}
    spark.createDataFrame([(k, t, "en", f"s{k % 2}", 0) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = {tuple(r) for r in QUERIES["code_structure"](spark, str(tmp_path)).select("path", "kind", "name", "returns", "documentation", "line").collect()}
    want = set()
    for k, t in texts.items():
        ext = ["rs", "go", "py", "js", "ts", "java"][k % 6]
        path, name, at = f"s{k % 2}/f{k}.{ext}", f"f{k}", (t or "").count("\n") + 2
        note = t or None if ext in ("rs", "go") else None
        if ext == "rs":
            want |= {(path, "function", name, "Option<u8>", note, at), (path, "struct", "S", None, None, at + 3)}
        elif ext == "go":
            want |= {(path, "function", name, "error", note, at), (path, "struct", "S", None, None, at + 3)}
        elif ext == "py":
            want |= {(path, "function", name, "int", "A note", at), (path, "class", "S", None, None, at + 3)}
        elif ext == "java":
            want |= {(path, "class", "S", None, None, at), (path, "function", name, "int", None, at + 1)}
        else:
            want |= {(path, "function", name, None, None, at), (path, "class" if ext == "js" else "interface", "S", None, None, at + 3)}
    assert made == want


def test_knn_label_precision_asks_for_every_vector(spark, tmp_path, monkeypatch):
    """Ids that 100 doesn't divide are asked for too, in one block or several; a label that one vector has isn't counted, as in the SQL."""
    rng = random.Random(7)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)], rng.choice([0, 0, 0, 1, 2])) for k in range(1, 98)] + [(200, [0.1] * 5, 9), (300, [0.1] * 5, 2), (301, [0.1] * 5, 0), (302, [0.5, -0.5, 0.5, 0.1, 0.2], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.sql(SQL["knn_label_precision"])
    want = dict(zip(want.columns, want.fetchall()[0]))
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    places, found = {k: unit(v) for k, v, _ in rows}, []
    for k, _, label in rows:
        if sum(r[2] == label for r in rows) > 1 and label is not None:
            near = sorted((r for r in rows if r[0] != k), key=lambda r: (-round(sum(a * b for a, b in zip(places[k], places[r[0]])), 12), r[0]))[:10]
            found.append(sum(r[2] == label for r in near) / 10)
    assert len(found) == 99 and want["precision"] == pytest.approx(sum(found) / 99, abs=1e-6)
    for size in (search.VECTORS, 20):
        monkeypatch.setattr(search, "VECTORS", size)
        assert QUERIES["knn_label_precision"](spark, str(tmp_path)).first().asDict() == pytest.approx(want, abs=2e-6)


def test_blocks_of_many_products_are_as_exact_as_one(spark, monkeypatch):
    """The bound that a product of single precision gives lets no neighbour go, however close the others are."""
    rng = random.Random(8)
    rows = [(k, [1.0 + rng.random() * (1e-6 if k % 2 else 1.0) for _ in range(6)]) for k in range(300)] + [(300 + k, [(k + 1) * 1.5] * 6) for k in range(20)]
    made = spark.createDataFrame(rows, "id int, embedding array<double>")
    asked = made.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = made.crossJoin(asked).select("query_id", "id", cosine(F.col("embedding"), F.col("query")).alias("s")).collect()
    by: dict = {}
    for p in pairs:
        by.setdefault(p["query_id"], []).append((-p["s"], p["id"]))
    want = sorted((q, i, -s, r) for q, of in by.items() for r, (s, i) in enumerate(sorted(of)[:7], 1))
    for step in (4096, 16):
        monkeypatch.setattr(search, "STEP", step)
        assert sorted(map(tuple, search.batch_search(made, asked, 7, "id").collect())) == want
