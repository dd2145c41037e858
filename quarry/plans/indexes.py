"""Queries over kept indexes: full text, saved searches and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import reverse
from quarry.plans.queries import ASCII_TOKENS, CATEGORY, CATEGORY_SQL, query, read
from quarry.session import scratch
from quarry.sources.index import TextIndex

#: What the index queries ask: words of the tables, one that only an update brings, and one that no document has.
ASKED = [["the", "and"], ["of", "changed"], ["token", "changed", "the"], ["der", "und", "die"], ["absentword", "the"]]
RANKED = ["token", "stupid", "changed", "the"]

#: Documents after the updates below: every seventh has one more word, every thirteenth is gone.
FINAL = f"""d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || ' changed' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0),
w AS MATERIALIZED (SELECT doc_id, list_filter({ASCII_TOKENS}, lambda x: x <> '') AS w FROM d)"""


def updated_index(spark, sf, merged: bool) -> TextIndex:
    """An index of all documents after a first load, an update, a removal and, if asked for, a merge of them."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    index = TextIndex(spark, scratch(spark), buckets=16)
    index.put(docs)
    index.put(docs.where("doc_id % 7 = 0").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" changed")).alias("text")))
    index.remove(docs.where("doc_id % 13 = 0"))
    if merged:
        index.merge()
    return index


@query(f"WITH {FINAL} SELECT q, doc_id FROM w JOIN (VALUES {', '.join(f'({k}, {a})' for k, a in enumerate(ASKED))}) a(q, asked) ON list_has_all(w, asked)")
def fulltext_conjunctions(spark, sf):
    """Documents that hold all of some words, from the index's posting blocks."""
    index = updated_index(spark, sf, merged=False)
    made = [index.holding(asked).select(F.lit(k).alias("q"), F.col("doc").alias("doc_id")) for k, asked in enumerate(ASKED)]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


@query(f"""WITH {FINAL}, n AS (SELECT count(*) AS n, avg(len(w)::DOUBLE) AS mean FROM w), t AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM w),
c AS (SELECT doc_id, size, term, count(*) AS c FROM t WHERE term IN {tuple(RANKED)} GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * c * 2.2::DOUBLE / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score FROM c JOIN f USING (term), n GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 50""")
def fulltext_ranked(spark, sf):
    """The fifty best documents for some words, after a merge."""
    made = updated_index(spark, sf, merged=True).ranked(RANKED, 50)
    return made.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {FINAL} SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY term")
def fulltext_terms(spark, sf):
    """Every word of the index with its documents and occurrences."""
    return updated_index(spark, sf, merged=False).terms()


SUBSCRIPTIONS = f"""s AS (SELECT c_custkey AS sub_id, CASE WHEN c_custkey % 3 > 0 THEN [{CATEGORY_SQL.format('c_custkey')}, {CATEGORY_SQL.format('(c_custkey + 1)')}] END AS categories,
  CASE WHEN c_custkey % 4 > 0 THEN ['src' || c_nationkey, 'src' || (c_custkey % 20)] END AS repositories, CASE WHEN c_custkey % 5 = 0 THEN [((c_custkey * 7) % 1000)::VARCHAR, c_custkey::VARCHAR] END AS document_ids,
  CASE c_custkey % 6 WHEN 0 THEN ['en', 'fr'] WHEN 1 THEN [] WHEN 2 THEN ['de'] END AS tags FROM customer)"""


@query(f"""WITH {SUBSCRIPTIONS}, d AS (SELECT doc_id, {CATEGORY_SQL.format('doc_id')} AS category, source AS repository, [lang] AS tags FROM documents)
SELECT sub_id, count(*) AS updates, sum(doc_id)::BIGINT AS ids FROM s JOIN d ON (categories IS NULL OR list_contains(categories, category)) AND (repositories IS NULL OR list_contains(repositories, repository))
  AND (document_ids IS NULL OR list_contains(document_ids, doc_id::VARCHAR)) AND (s.tags IS NULL OR list_has_any(s.tags, d.tags)) GROUP BY 1""")
def subscription_matches(spark, sf):
    """Documents for every customer's subscription, as counts: equal subscriptions and equal documents are one row each."""
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    src = lambda x: F.concat(F.lit("src"), x.cast("string"))
    subs = c.select(
        k.alias("sub_id"), F.when(k % 3 > 0, F.array(CATEGORY(k), CATEGORY(k + 1))).alias("categories"), F.when(k % 4 > 0, F.array(src(F.col("c_nationkey")), src(k % 20))).alias("repositories"),
        F.when(k % 5 == 0, F.array(((k * 7) % 1000).cast("string"), k.cast("string"))).alias("document_ids"),
        F.when(k % 6 == 0, F.array(F.lit("en"), F.lit("fr"))).when(k % 6 == 1, F.array().cast("array<string>")).when(k % 6 == 2, F.array(F.lit("de"))).alias("tags"),
    )
    docs = read(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), CATEGORY(F.col("doc_id")).alias("category"), F.col("source").alias("repository"), F.array("lang").alias("tags"))
    lists = {"categories": "category", "repositories": "repository", "document_ids": "document_id", "tags": "tags"}
    return reverse.tallied(docs, subs, lists, ["sub_id"], "doc_id").select("sub_id", F.col("n").alias("updates"), F.col("total").alias("ids"))


@query(f"""WITH q AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: x <> '')[1:3] AS w, 'src' || (item_id % 20) AS source FROM benchmark),
d AS MATERIALIZED (SELECT doc_id, source, n_chars, list_filter({ASCII_TOKENS}, lambda x: x <> '') AS w FROM documents)
SELECT item_id, count(*) AS documents, sum(doc_id)::BIGINT AS ids FROM q JOIN d ON q.source = d.source AND list_has_any(q.w, d.w) AND n_chars >= 300 GROUP BY 1""")
def saved_search_matches(spark, sf):
    """Documents for a search that each benchmark item saved as JSON: any of its first three words, in one source, of some length."""
    b = read(spark, sf, "benchmark")
    words = F.array_join(F.slice(F.filter(F.split(F.lower("text"), r"[^\p{IsAlphabetic}\p{N}_-]+", -1), lambda w: w != ""), 1, 3), " ")
    source = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    clause = lambda kind, field, value, gte: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(gte).cast("int").alias("gte"))
    must = F.array(clause("term", "source", source, None), clause("range", "n_chars", F.lit(None), 300))
    bool_query = F.struct(must.alias("must"), F.array().cast("array<string>").alias("should"), F.array().cast("array<string>").alias("must_not"), F.lit(0).alias("minimum_should_match"))
    saved = b.select("item_id", F.to_json(F.struct(words.alias("query"), bool_query.alias("bool_query"))).alias("request"))
    docs = read(spark, sf, "documents").select("doc_id", "source", "n_chars", "text")
    index = reverse.indexed(reverse.of_json(saved, content="text"))
    found = reverse.matched(docs, index, reverse.held(["source"], texts=["text"]), ["item_id"], reverse.numbers({"n_chars": F.col("n_chars")}))
    return found.groupBy("item_id").agg(F.count("doc_id").alias("documents"), F.sum("doc_id").alias("ids"))
