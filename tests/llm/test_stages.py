"""The pipeline's mixing and packing stages, row by row: against the SQL of the mixing, and the tokenizer's own ids."""

import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import mixing

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_mixing_stage_keeps_the_rows_of_its_budget(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = corpus_pipeline.mixing(spark, docs.repartition(5), SF)
    assert made.columns == docs.columns
    documents = docs.toPandas()  # noqa: F841  read by name
    weight = "CASE WHEN lang = 'en' AND source IS NULL THEN 3 ELSE 1 END"
    want = duckdb.sql(mixing.oracle("'web'", weight, corpus_pipeline.SHARE, corpus_pipeline.EPOCHS, corpus_pipeline.SEED)).fetchall()
    assert sorted(r["doc_id"] for r in made.select("doc_id").collect()) == sorted(r[0] for r in want)
    assert 0 < made.count() < docs.count()
    whole = {r["doc_id"]: r for r in docs.collect()}
    assert all(whole[r["doc_id"]] == r for r in made.collect())


def held_pieces(made):
    """Pieces by document and by sequence; every sequence gapless and within its size."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in made:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048
    return by_doc, by_sequence


def padded(total):
    """Places of a sequence: 2048, except at a power of two."""
    return total if total & (total - 1) == 0 else 2048


def test_packing_stage_holds_every_id_once_over_many_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(24)
    docs = docs.union(docs.limit(1).select(F.lit(-5).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *[c for c in docs.columns if c not in ("doc_id", "text")]).select(*docs.columns))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*e.ids, 1], "<u4") for i, e in zip(rows, library.encode_batch(list(rows.values()), add_special_tokens=False))}
    by_doc, by_sequence = held_pieces(corpus_pipeline.packing(spark, docs, SF).collect())
    assert set(by_doc) == set(rows)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(ids[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[i])
    tokens = sum(map(len, ids.values()))
    places = sum(padded(sum(p["length"] for p in pieces)) for pieces in by_sequence.values())
    assert 1 - tokens / places < 0.12, 1 - tokens / places


def test_stages_in_a_row(spark):
    """What run gives is what its stages give, one after the other, on what each kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        ids = {r[0] for r in after.select("doc_id").collect()}
        assert ids <= {r[0] for r in docs.select("doc_id").collect()}
        kept.append(len(ids))
        docs = after
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
