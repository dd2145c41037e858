"""Words of megabytes, pages of megabytes, and many words of one document, for the operators that hash, split or merge words."""

import random
import string

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import codebooks, discriminant, manifest, ngram_join, token_counts, toxicity, url_filters


def letters(n, seed):
    return "".join(random.Random(seed).choices(string.ascii_lowercase, k=n))


def test_a_word_of_megabytes(spark):
    word = letters(1_000_000, 1)
    rows = [(1, word), (2, word), (3, word[:-1] + "#"), (4, f"{word} two three four"), (5, f"{word} two three four"), (6, "short"), (7, word.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert made == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (2, 4), 5: (2, 4), 6: (1, 6), 7: (1, 1)}
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity(docs, labels).count() == 7 and discriminant.quality(docs, labels).count() == 7


def test_token_counts_of_long_runs(spark):
    texts = [letters(300_000, 2), "a" * 400_000, "ü" * 50_000, " " * 100_000 + "x", letters(50_000, 3).upper()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert [made[k] for k in range(len(texts))] == want


def test_long_pages_and_names(spark):
    html = "<p>" + " ".join(letters(6, k) for k in range(20_000)) + " casino</p><script>" + "x" * 1_000_000 + "</script>"
    rows = [(1, "http://casino.example.com/" + "a/" * 5_000, html), (2, "http://" + letters(9_000, 5) + ".org/", None), (3, "http://plain.com/", "casino plain")]
    made = {r["page_id"]: r for r in url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), []).collect()}
    assert set(made) == {1, 2, 3} and all(r["verdict"] in ("block", "allow") and r["log_odds"] is not None for r in made.values())
    assert made[1]["log_odds"] > made[3]["log_odds"]


def test_long_texts_in_a_manifest(spark):
    rows = [(k, "s", "en", 1, letters(1_000_000, k % 2) + "\n") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    made = manifest.manifest(docs, F.translate("text", "\n", ""), per=2).collect()
    assert len(made) == 6 and not any(r["verified"] for r in made) and len({r["root"] for r in made}) == 1


def test_one_vector_for_a_third_of_the_rows(spark):
    rng = random.Random(7)
    rows = [(k, [1.0, 2.0, 3.0, 4.0] if k % 3 == 0 else [rng.gauss(0, 1) for _ in range(4)], 0 if k % 3 else None) for k in range(1500)]
    made = codebooks.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    assert len(made) == 1500 and len({r["code"] for r in made if r["vec_id"] % 3 == 0}) == 1
    assert {r["label_error"] for r in made if r["label"] is None} == {sum(r["error"] for r in made if r["label"] is None)}
