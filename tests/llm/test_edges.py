"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, neighbours, ngram_join, packing, personal_data, quality_rules, suffixes, token_counts, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, hash int, host string, body string, n_tokens int, row string, tokens string, __key string, number int, wordless int, first int, found int, line int"
EXTRA = ("x", "y", 3, "h", "b", 9, "r", "t", "k", 1, 1, 1, 1, 1)
LONG = "word " * 60_000
MANY = " ".join(f"{k:x}" for k in range(60_000))
COPY = "one two three four five six seven eight nine ten " * 10
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n", "en", "a", 3), (4, COPY, "en", "a", 1), (5, COPY, "en", None, 1), (5, COPY, "en", None, 1),
    (None, COPY, "de", "b", 1), (6, LONG, "en", "a", 1), (7, "é日本 😀 mail a.b@c.de", "fr", "c", 1), (8, "idiot scum trash", "en", "a", 1), (None, None, None, None, None), (9, "two words", "en", "a", 1), (10, "Two  WORDS", "en", "a", 1), (11, MANY, "en", "a", 1),
]
LABELS = "doc_id long, quality int, toxic int"
BPE, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


OPERATORS = {
    "quality": lambda d, s: quality_rules.line_quality(d),
    "suffixes": lambda d, s: suffixes.repeated_passages(d),
    "personal": lambda d, s: personal_data.personal_data(d),
    "toxicity": lambda d, s: toxicity.toxicity(d, s.createDataFrame([(8, 1, 1), (None, 1, 1), (4, None, None)], LABELS)),
    "ngrams": lambda d, s: ngram_join.ngram_components(d),
    "tokens": lambda d, s: token_counts.token_counts(d, BPE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, docs, nothing, name):
    made = OPERATORS[name](docs, spark).collect()
    assert sorted(str(r["doc_id"]) for r in made) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](nothing, spark).collect() == []


def test_values_at_the_edges(spark, docs):
    q = by_id(quality_rules.line_quality(docs))
    assert q[1]["n_words"] == 0 and q[1]["base_failed"] and not q[1]["kept"] and q[6]["n_repeat_words"] == 60_000
    s = by_id(suffixes.repeated_passages(docs))
    assert s[4]["n_removed"] == len(COPY) and s[1]["n_bytes"] == 0 and s[6]["n_removed"] == len(LONG) and s[7]["n_removed"] == 0
    p = by_id(personal_data.personal_data(docs))
    assert p[7]["n_email"] == 1 and p[7]["spans"] == "email:11:19" and p[1]["redacted"] is None and p[2]["spans"] == ""
    t = by_id(toxicity.toxicity(docs, spark.createDataFrame([], LABELS)))
    assert t[8]["predicted"] == 1 and t[1]["score"] == t[2]["score"] < 0.7
    n = by_id(ngram_join.ngram_components(docs))
    assert n[4]["component_id"] == n[5]["component_id"] == 4 and n[9]["component_id"] == n[10]["component_id"] == 9
    assert n[1]["n_shingles"] == n[3]["n_shingles"] == 0 and n[2]["component_id"] == 2 and n[6]["n_shingles"] == 1


def test_packing_keeps_every_id(spark, docs, nothing):
    made = packing.packed(docs, RANKS, BPE, {"<|endoftext|>": 50256}).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    assert sum(r["length"] for r in made) == sum(len(own.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    for q in {r["sequence_id"] for r in made}:
        rows = sorted((r for r in made if r["sequence_id"] == q), key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        assert sum(r["length"] for r in rows) <= 2048
    assert packing.packed(nothing, RANKS, BPE, {}).collect() == []


def test_mixing(spark, docs, nothing):
    made = mixing.mixed(docs, {}, 1.0, 1).collect()
    assert sorted(str(r["doc_id"]) for r in made) == sorted(str(r[0]) for r in ROWS if (r[1] or "").split())
    assert mixing.mixed(nothing, {}, 0.5, 2).collect() == []
    assert mixing.chosen(docs, {}, 1.0, 1).select("row.*").columns == docs.columns
    assert mixing.chosen(nothing, {}, 1.0, 1).select("row.*").collect() == []


def test_url_filter(spark):
    schema = "page_id long, url string, html string, host int, path int, rule int"
    rows = [(1, None, None, 1, 1, 1), (2, "", "", 1, 1, 1), (3, "no scheme", "<p>x", 1, 1, 1), (4, "http://A.Net", "x", 1, 1, 1), (4, "http://A.Net/", "x", 1, 1, 1), (None, "x://" + "ab" * 20_000 + "/p", "y", 1, 1, 1)]
    made = url_filters.url_filter(spark.createDataFrame(rows, schema), [("net/", "block")]).collect()
    assert len(made) == len(rows)
    got = {(r["page_id"], r["host"][:10], r["path"], r["rule"], r["verdict"]) for r in made}
    # the only block row has the word a; the many unknown stretches of the long host make every word rare among allow rows
    assert (1, "", "", None, "allow") in got and (4, "a.net", "", None, "block") in got and (4, "a.net", "/", "net/", "block") in got
    assert all(r["rule"] or r["verdict"] == ("block" if r["log_odds"] > math.log(9) else "allow") for r in made)
    assert url_filters.url_filter(spark.createDataFrame([], schema), [("net/", "block")]).collect() == []


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, packed int, vid int, key int, id string"
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, []), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (2, [1.0, 0.0])]
    made = neighbours.nearest(spark.createDataFrame([(*v, 1, 1, 1, "x") for v in vectors], schema), F.col("id") % 2 == 0, k=2)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in made.orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (2, 1, 0, 1.0), (2, 2, 3, 1.0), (8, 1, 0, 0.5), (8, 2, 1, 0.5)]
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("id") % 2 == 0).collect() == []


def test_pipeline_stages(spark, docs, nothing, tmp_path):
    """Every stage of the pipeline on rows with nulls, repeats and clashing names, and on none."""
    import corpus_pipeline

    spark.createDataFrame([(8, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, nothing):
            made = stage(spark, d, str(tmp_path))
            assert made.columns == d.columns, name
            assert made.count() <= d.count()
    name, stage = corpus_pipeline.STAGES[-1]
    made = stage(spark, docs, str(tmp_path))
    assert made.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert stage(spark, nothing, str(tmp_path)).collect() == []


def test_stages_keep_columns(spark, docs, nothing):
    labels = spark.createDataFrame([(8, 1, 1)], LABELS)
    for d in (docs, nothing):
        for made in (toxicity.without_toxic(d, labels), ngram_join.one_of_each(d), personal_data.without_personal_data(d)):
            assert made.columns == d.columns
            made.collect()
    kept = [r["doc_id"] for r in ngram_join.one_of_each(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, 3, 4, 6, 7, 8, 9, 11, None]))
    assert 8 not in {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()}
    clean = by_id(personal_data.without_personal_data(docs))[7]
    assert clean["text"].endswith("mail [email]") and clean["n_chars"] == len(clean["text"])
