"""Reverse search against the nested loop: subscriptions, saved requests, and searches kept in a store."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import reverse, search
from quarry.operators.search import BoolQuery, Filters, Match, MultiMatch, QueryError, Range, Request, SavedSearch, Term
from quarry.streaming import events

WORDS = ["stone", "river", "light", "garden", "walk", "under", "house", "größe"]
SUBS = "conn_id string, sub_id int, categories array<string>, repositories array<string>, document_ids array<string>, tags array<string>"
DOCS = "document_id string, category string, repository string, tags array<string>, _doc string"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("small", [True, False])
def test_subscriptions(spark, small):
    rng = random.Random(3)
    some = lambda values, most=3: rng.choice([None, None, [], [None, "x"], *[rng.sample(values, rng.randint(1, most)) for _ in range(6)]])
    cats, repos, ids, tags = (list(x) for x in ("abcd", ["r1", "r2", "r3"], [f"d{k}" for k in range(12)], ["t1", "t2", "t3", "t4"]))
    subs = [(f"c{k % 9}", k, some(cats), some(repos), some(ids), some(tags)) for k in range(150)]
    docs = [(rng.choice([None, *ids]), rng.choice([None, *cats]), rng.choice([None, *repos]), rng.choice([None, [], [None], tags, tags[:2], tags[1:2] * 2]), "own") for _ in range(60)]
    holds = lambda wanted, value: wanted is None or value is not None and value in wanted
    fits = lambda s, d: holds(s[2], d[1]) and holds(s[3], d[2]) and holds(s[4], d[0]) and (s[5] is None or bool(set(s[5]) & {t for t in d[3] or [] if t is not None}))
    want = sorted(str((s[0], s[1], *d)) for s in subs for d in docs if fits(s, d))
    lists = {"categories": "category", "repositories": "repository", "document_ids": "document_id", "tags": "tags"}
    docs_, subs_ = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(subs, SUBS)
    of = reverse.held(["category", "repository", "document_id"], ["tags"])
    for known in (None, reverse.frequencies(docs_, of)):
        index = reverse.indexed(reverse.of_subscriptions(subs_, lists), known)
        made = reverse.matched(docs_, index, of, ["conn_id", "sub_id"], small=small)
        assert sorted(str(tuple(r)) for r in made.collect()) == want and want
        assert "NestedLoop" not in plan(made) and "Cartesian" not in plan(made)
    assert sorted(str(tuple(r)) for r in events.delivered(docs_, subs_).collect()) == want


def test_the_rarest_group_is_the_entry(spark):
    subs = spark.createDataFrame([("c", 1, ["common"], ["r1", "r2", "r3"], None, None), ("c", 2, None, None, None, None)], SUBS)
    docs = spark.createDataFrame([(str(k), "common", "r1" if k == 0 else "other", None, "") for k in range(20)], DOCS)
    of = reverse.held(["category", "repository"])
    lists = {"categories": "category", "repositories": "repository"}
    entry = lambda known: {(r["sub_id"], r["key"]) for r in reverse.indexed(reverse.of_subscriptions(subs, lists), known).collect()}
    assert entry(None) == {(1, "category=common"), (2, "")}
    assert entry(reverse.frequencies(docs, of)) == {(1, "repository=r1"), (1, "repository=r2"), (1, "repository=r3"), (2, "")}


def requests(rng, n):
    words = lambda: " ".join(rng.sample(WORDS, rng.randint(1, 2)))
    clause = lambda: rng.choice([Match("content", words()), Match("title", words()), Term("category", rng.choice(["tutorial", "Reference"])), Term("tags", rng.choice(["t1", "t2"]), listed=True)])
    out = []
    for k in range(n):
        should = tuple(clause() for _ in range(rng.randint(0, 3)))
        must = tuple(rng.choice([clause(), Range("similarity", rng.choice([None, 0.3]), rng.choice([None, 0.8]))]) for _ in range(rng.randint(0, 2)))
        b = BoolQuery(must, should, tuple(clause() for _ in range(rng.randint(0, 1))), rng.randint(0, len(should)))  if must or should else None
        f = Filters(rng.choice([(), ("Tutorial", "reference")]), rng.choice([(None, None), (0.2, None), (0.1, 0.9)]), rng.choice([(None, None), ("2025-01-03", None), ("2025-01-02", "2025-01-06")]), rng.choice([(), ("t1",)]), rng.choice([(), ("r1", "r2")]))
        out.append(Request(rng.choice([None, words(), "absent"]) if b else words(), rng.choice([None, MultiMatch(words(), ("title", "content"), {"title": 2.0})]), b, f))
    return out


def documents(spark, rng, n):
    rows = []
    for k in range(n):
        text = lambda m: rng.choice([None, "", *[" ".join(rng.choices(WORDS, k=m)).upper() for _ in range(4)]])
        rows.append((k, text(3), text(8), rng.choice([None, "tutorial", "Tutorial", "Reference"]), rng.choice([None, [], ["t1"], ["t2", None, "t1"]]), rng.choice([None, "r1", "r3"]), rng.choice([None, 0.1, 0.3, 0.8, 0.95]), f"2025-01-0{rng.randint(1, 9)}"))
    made = spark.createDataFrame(rows, "id int, title string, content string, category string, tags array<string>, repository string, similarity double, day string")
    return made.withColumn("updated_at", F.col("day").cast("timestamp")).cache()


def test_saved_requests_match_as_a_search_does(spark):
    rng = random.Random(8)
    docs, asked = documents(spark, rng, 60), requests(rng, 24)
    want = sorted((str(k), r["id"]) for k, q in enumerate(asked) for r in q.matches(docs).select("id").collect())
    index = reverse.indexed(reverse.of_saved(spark, {str(k): q for k, q in enumerate(asked)}))
    of = reverse.held(["category", "repository"], ["tags"], ["title", "content"])
    values = reverse.numbers({"similarity": F.col("similarity"), "updated_at": F.unix_micros("updated_at") / 1e6})
    made = reverse.matched(docs, index, of, ["search_id"], values)
    assert sorted((r["search_id"], r["id"]) for r in made.collect()) == want and len(want) > 30


def test_requests_come_back_from_json():
    for q in requests(random.Random(1), 40):
        assert reverse.from_json(reverse.to_json(q)) == q
    for bad in ("{", "{}", '{"query": "a", "filters": {"categories": ["none"]}}', '{"query": "a", "options": {"unknown": 1}}', "[]"):
        with pytest.raises(QueryError):
            reverse.from_json(bad)


def test_searches_in_a_store(spark, tmp_path):
    kept = reverse.SavedSearches(spark, str(tmp_path / "saved"), buckets=4)
    one, two = SavedSearch("ann", "rivers", Request("river")), SavedSearch("ben", "stones", Request("stone"), "all of them")
    kept.save([one, two, SavedSearch("ann", "rivers", Request("light"))])  # the last one of a name
    first = kept.of_user("ann").collect()
    assert [(r["name"], reverse.from_json(r["request"]).query) for r in first] == [("rivers", "light")]
    kept.save([one, SavedSearch("ann", "houses", Request("house"))])
    rows = {r["name"]: r for r in kept.of_user("ann").collect()}
    assert set(rows) == {"rivers", "houses"} and rows["rivers"]["created_at"] == first[0]["created_at"] < rows["rivers"]["updated_at"]
    assert kept.of_user("ben").first()["description"] == "all of them"
    docs = spark.createDataFrame([(1, "a river of light"), (2, "a stone house"), (3, None)], "id int, content string")
    found = reverse.matched(docs, reverse.indexed(kept.predicates()), reverse.held(texts=["content"]), ["user_id", "name"])
    assert sorted((r["user_id"], r["name"], r["id"]) for r in found.collect()) == [("ann", "houses", 2), ("ann", "rivers", 1), ("ben", "stones", 2)]
    assert kept.delete("ann", "rivers") and not kept.delete("ann", "rivers") and [r["name"] for r in kept.of_user("ann").collect()] == ["houses"]


def test_a_hot_key_and_nothing_asked(spark):
    subs = spark.createDataFrame([("c", k, ["hot"], None, [f"d{k}"], None) for k in range(300)], SUBS)
    docs = spark.createDataFrame([(f"d{k}", "hot", None, None, "") for k in range(300)], DOCS)
    lists = {"categories": "category", "document_ids": "document_id"}
    of = reverse.held(["category", "document_id"])
    index = reverse.indexed(reverse.of_subscriptions(subs, lists), reverse.frequencies(docs, of))
    assert index.where("key = 'category=hot'").count() == 0  # the rare list is the entry: 300 candidates, not 90 000
    assert reverse.matched(docs, index, of, ["sub_id"]).count() == 300
    assert reverse.matched(docs.limit(0), index, of, ["sub_id"]).collect() == [] and reverse.matched(docs, index.limit(0), of, ["sub_id"]).collect() == []


def test_tallies_are_those_of_the_pairs_without_making_them(spark):
    rng = random.Random(8)
    some = lambda values: rng.choice([None, None, [], [None, "x"], *[rng.choices(values, k=2) for _ in range(4)]])
    subs = spark.createDataFrame([("c", k % 140, some(list("abc")), some(["r1", "r2"]), some([f"d{k}" for k in range(20)]), some(["t1", "t2", "t3"])) for k in range(150)], SUBS)
    kinds = [(rng.choice([None, *"abcd"]), rng.choice([None, "r1", "r2"]), rng.choice([None, [], [None], ["t1", "t2"], ["t2", "t1"], ["t3"]])) for _ in range(12)]
    rows = [(f"d{k % 90}", *kinds[k % 12], "own", k) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS + ", n long")
    lists = {"categories": "category", "repositories": "repository", "document_ids": "document_id", "tags": "tags"}
    of = reverse.held(["category", "repository", "document_id"], ["tags"])
    pairs = reverse.matched(docs, reverse.indexed(reverse.of_subscriptions(subs, lists)), of, ["sub_id"])
    want = sorted(tuple(r) for r in pairs.groupBy("sub_id").agg(F.count("*"), F.sum("n")).collect())
    assert sorted(tuple(r) for r in reverse.tallied(docs, subs, lists, ["sub_id"], "n").collect()) == want and len(want) > 20


def test_tallies_of_hot_groups(spark):
    """Half a million subscriptions to what half a million documents are: pairs would never end."""
    subs = spark.range(500_000).select(F.col("id").alias("sub_id"), F.array(F.lit("hot")).alias("categories"), F.when(F.col("id") % 1000 == 0, F.array(F.col("id").cast("string"))).alias("document_ids"))
    docs = spark.range(500_000).select("id", F.col("id").cast("string").alias("document_id"), F.lit("hot").alias("category"))
    made = reverse.tallied(docs, subs, {"categories": "category", "document_ids": "document_id"}, ["sub_id"], "id", several=())
    assert made.agg(F.count("*"), F.sum("n"), F.max("total")).first()[:] == (500_000, 499_500 * 500_000 + 500, 499_999 * 250_000)


@pytest.mark.parametrize("small", [True, False])
def test_a_key_of_more_predicates_than_a_cell(spark, monkeypatch, small):
    monkeypatch.setattr(reverse, "CELL", 3)
    rng = random.Random(5)
    docs, asked = documents(spark, rng, 50), requests(rng, 24)
    asked += [Request(bool_query=BoolQuery(must=(Term("repository", "r1"),), must_not=(Match("content", w),))) for w in WORDS]
    want = sorted((str(k), r["id"]) for k, q in enumerate(asked) for r in q.matches(docs).select("id").collect())
    index = reverse.indexed(reverse.of_saved(spark, {str(k): q for k, q in enumerate(asked)}))
    cells = reverse.celled(index, ["search_id"]).collect()
    assert sum(len(r["_asks"]) for r in cells) == index.count() and sum(r["_key"] == "repository=r1" for r in cells) > 1
    of = reverse.held(["category", "repository"], ["tags"], ["title", "content"])
    values = reverse.numbers({"similarity": F.col("similarity"), "updated_at": F.unix_micros("updated_at") / 1e6})
    made = reverse.matched(docs, index, of, ["search_id"], values, small)
    assert sorted((r["search_id"], r["id"]) for r in made.collect()) == want and len(want) > 30


def test_keys_of_a_long_text_are_not_copied_for_each_of_them(spark):
    """Thirty texts of 40 000 different words: a row with all keys for each key would be some 800 GB."""
    docs = spark.range(30).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda k: F.concat(F.lit("w"), k.cast("string")))).alias("content"), F.lit("r1").alias("repository"))
    asked = {str(k): Request(f"w{k} absent", bool_query=BoolQuery(must=(Term("repository", "r1"),))) for k in range(40)} | {"none": Request("absent", bool_query=BoolQuery(must=(Term("repository", "r1"),)))}
    index = reverse.indexed(reverse.of_saved(spark, asked))
    begun = time.monotonic()
    made = reverse.matched(docs, index, reverse.held(["repository"], texts=["content"]), ["search_id"])
    assert made.agg(F.count("*"), F.countDistinct("search_id"), F.sum("id")).first()[:] == (1200, 40, 40 * 435)
    assert time.monotonic() - begun < 60
