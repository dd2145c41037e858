"""Votes of the toxicity model by the words themselves; what it misses; texts without meaning."""

import random
import re
import string
import zlib

import pytest

from quarry.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text")
    return toxicity.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"), 6000)


def made_up(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 11))) for _ in range(n))


def test_words_without_meaning_score_as_nothing(model):
    empty = model.score("", {})
    for n in (50, 5_000, 20_000):
        for seed in range(6):
            assert abs(model.score(made_up(n, seed), {}) - empty) < 0.05
    with_words = model.score("the river ran khkhcqjkfo eebyrbyoiv under the old bridge", {})
    assert abs(with_words - model.score("the river ran under the old bridge", {})) < 1e-6


def test_votes_by_brute_force(model):
    names = list(model.lexicon)
    texts = [made_up(300, 9), " ".join(names[:40]).replace("^", ""), "Stupid STUPIDITY stupendous; idiot, worthlessness!!", "", "ein achlicher Satz"]
    for text in texts:
        words = re.findall(r"[^\W\d_]+", text.lower())
        votes = {v: sum(w == x or x[0] == "^" and len(w) > len(x) - 1 and w.startswith(x[1:]) for w in words) for x, v in model.lexicon.items()}
        total, each = model.hits(toxicity.read(text)[0], {})
        assert dict(each) == {v: n for v, n in votes.items() if n}
        assert total == sum(any(w == x or x[0] == "^" and len(w) > len(x) - 1 and w.startswith(x[1:]) for x in names) for w in words)


def test_what_is_missed_holds_no_word_of_the_list_twice(spark, model):
    """Held-out marked rows: all but marks without a reason in the text are found, and no other row is flagged."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic").collect()
    rows = [(r["text"] or "", r["toxic"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    scores = [model.score(t, {}) for t, _ in rows]
    listed = lambda t: sum(w in toxicity.WORDS for w in re.findall(r"[^\W\d_]+", t.lower()))
    missed = [t for (t, toxic), s in zip(rows, scores) if toxic and s < 0.7]
    assert all(listed(t) <= 1 for t in missed) and sum(listed(t) for t in missed) <= 2
    assert sum(s >= 0.7 for (_, toxic), s in zip(rows, scores) if not toxic) <= 2
    assert len(missed) <= 0.2 * sum(toxic for _, toxic in rows)
