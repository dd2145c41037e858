"""Queries over the driver's tables, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.functions import changes, quality, text as tx, vector as vx
from quarry.operators import analytics, chunking, code, crossref, incremental, ingest, intents, keywords, monitoring, prompts, search
from quarry.session import scratch, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# -- views -------------------------------------------------------------------


def search_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as search events: views ask, clicks click, purchases end a session."""
    e = read(spark, sf, "events")
    n = F.floor("value")
    return e.where("event_type in ('view', 'click', 'purchase')").select(
        F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "click", "click").otherwise("session_end").alias("type"),
        (F.col("event_id") - F.pmod("event_id", F.lit(3))).alias("query_id"), F.concat("user_id", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), "user_id",
        F.concat(F.lit("query "), F.pmod("user_id", F.lit(50)).cast("string")).alias("query"), F.when(F.pmod("user_id", F.lit(3)) == 0, "advanced").otherwise("simple").alias("query_type"),
        n.cast("long").alias("result_count"), F.floor(F.col("value") * 10).cast("long").alias("execution_time_ms"), (n == 0).alias("zero_results"),
        F.pmod(n, F.lit(12)).cast("long").alias("position"), F.floor(F.col("value") * 20).cast("long").alias("time_to_click_ms"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"), "ts", "event_id",
    )


EV = """
WITH ev AS (SELECT CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'click' ELSE 'session_end' END AS type,
  event_id - event_id % 3 AS query_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id, user_id,
  'query ' || (user_id % 50) AS query, CASE WHEN user_id % 3 = 0 THEN 'advanced' ELSE 'simple' END AS query_type,
  floor(value)::BIGINT AS result_count, floor(value * 10)::BIGINT AS execution_time_ms, floor(value) = 0 AS zero_results,
  (floor(value)::BIGINT % 12) AS position, floor(value * 20)::BIGINT AS time_to_click_ms, floor(value * 1000)::BIGINT AS duration_ms, ts, event_id
  FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""

CATEGORY = lambda c: F.element_at(F.array(*map(F.lit, quality.CATEGORIES)), (F.pmod(c, F.lit(4)) + 1).cast("int"))
CATEGORY_SQL = "(['tutorial', 'how-to', 'reference', 'explanation'])[({} % 4) + 1]"


# -- sources, hashes, diffs --------------------------------------------------


@query("SELECT doc_id, sha256(text) AS hash, length(sha256(text)) = 64 AS valid FROM documents")
def content_hash(spark, sf):
    h = tx.content_hash(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", h.alias("hash"), tx.is_hash(h).alias("valid"))


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    d = read(spark, sf, "documents").groupBy(tx.content_hash(F.col("text")).alias("hash"))
    return d.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


def two_states(spark, sf):
    d = read(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    current = d.where("doc_id % 7 <> 0").select("path", tx.content_hash(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return current, d.where("doc_id % 11 <> 0").select("path", tx.content_hash(F.col("text")).alias("hash"))


STATES = """
WITH c AS (SELECT 'doc/' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0),
e AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0),
x AS (SELECT coalesce(c.path, e.path) AS path, CASE WHEN e.h IS NULL THEN 'add' WHEN c.h IS NULL THEN 'delete' WHEN c.h = e.h THEN 'skip' ELSE 'update' END AS action
      FROM c FULL JOIN e ON c.path = e.path)"""


@query(STATES + " SELECT path, action FROM x")
def incremental_diff(spark, sf):
    return incremental.compared(*two_states(spark, sf)).select("path", "action")


@query(STATES + " SELECT " + ", ".join(f"count(*) FILTER (action = '{a}') AS \"{a}\"" for a in incremental.ACTIONS) + " FROM x")
def load_stats(spark, sf):
    return incremental.counted(incremental.compared(*two_states(spark, sf)))


@query(STATES + " SELECT path, action FROM x WHERE action IN ('add', 'update')")
def load_plan(spark, sf):
    return incremental.planned(incremental.compared(*two_states(spark, sf)), incremental.LoadFlags(update=True)).select("path", "action")


@query(STATES + """ SELECT path, h AS hash FROM (SELECT e.path, e.h FROM e JOIN x USING (path) WHERE action = 'skip'
  UNION ALL SELECT c.path, c.h FROM c JOIN x USING (path) WHERE action IN ('add', 'update'))""")
def store_after_load(spark, sf):
    current, existing = two_states(spark, sf)
    plan = incremental.planned(incremental.compared(current, existing), incremental.LoadFlags(update=True, cleanup=True))
    return incremental.applied(existing, plan, current)


# -- segmentation ------------------------------------------------------------

_MASKED = "text"
for _a in tx.ABBREVIATIONS:
    _MASKED = f"replace({_MASKED}, '{_a}', '{_a.replace('.', chr(0xE000))}')"
SENTENCES_SQL = f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_MASKED}, '([.!?])([^\\S\\r\\n]*(?:[\\r\\n]|\\p{{Lu}}))', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
  lambda x: translate(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), chr(57344), '.')), lambda x: length(x) >= 10) AS s FROM documents)"""


@query(SENTENCES_SQL + " SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(1))) AS digest, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s")
def sentences(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\x01").cast("binary")).alias("digest"), longest.cast("long").alias("longest"))


@query("""SELECT doc_id, 'chunk_' || (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1) AS chunk_id, count(*) OVER (PARTITION BY doc_id) AS total, length(p) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS k FROM documents) WHERE trim(p, ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def paragraph_chunks(spark, sf):
    p = tx.paragraphs(F.col("text"))
    each = read(spark, sf, "documents").select("doc_id", F.size(p).cast("long").alias("total"), F.posexplode(p).alias("k", "p"))
    return each.select("doc_id", F.concat(F.lit("chunk_"), F.col("k").cast("string")).alias("chunk_id"), "total", F.length("p").cast("long").alias("chars"))


@query("SELECT doc_id, ceil(strlen(text) / 4.0::DOUBLE * 1.3::DOUBLE)::BIGINT AS tokens, ceil(strlen(text) / 4.0::DOUBLE * 1.3::DOUBLE) <= 3584 AS fits FROM documents")
def token_budget(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), tx.fits(F.col("text")).alias("fits"))


@query("""SELECT conv_id, turn, tokens, spent FROM (SELECT conv_id, turn, tokens, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS spent
  FROM (SELECT *, ceil(strlen(text) / 4.0::DOUBLE * 1.3::DOUBLE)::BIGINT AS tokens FROM conversations)) WHERE spent <= 512""")
def priority_packing(spark, sf):
    """Turns that fit a budget of 512 tokens, the latest first."""
    t = read(spark, sf, "conversations").select("conv_id", "turn", tx.token_estimate(F.col("text")).alias("tokens"))
    run = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("spent", F.sum("tokens").over(run)).where("spent <= 512")


@query("""SELECT doc_id, n, length(piece) AS chars, md5(piece) AS digest FROM (SELECT doc_id, unnest(range(0, greatest(length(text) - 51, 0) + 1, 950))::BIGINT // 950 AS n,
  substr(text, unnest(range(0, greatest(length(text) - 51, 0) + 1, 950))::BIGINT + 1, 1000) AS piece FROM documents WHERE length(text) > 0)""")
def fixed_chunks(spark, sf):
    each = read(spark, sf, "documents").select("doc_id", F.posexplode(tx.overlapping_chunks(F.col("text"), 1000, 50)).alias("n", "piece"))
    return each.select("doc_id", F.col("n").cast("long").alias("n"), F.length("piece").cast("long").alias("chars"), F.md5(F.col("piece").cast("binary")).alias("digest"))


@query("""SELECT doc_id, i::INTEGER AS k, round(ascii(substr(sha256(text), i % 64 + 1, 1)) / 255.0::DOUBLE, 4) AS x FROM documents, range(0, 384) r(i)""")
def hash_embeddings(spark, sf):
    each = read(spark, sf, "documents").select("doc_id", F.posexplode(tx.hash_embedding(F.col("text"))).alias("k", "x"))
    return each.select("doc_id", "k", F.round(F.col("x").cast("double"), 4).alias("x"))


# -- vectors and chunking ----------------------------------------------------

V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query(V + """ SELECT vec_id, round(list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0)), 6) AS similarity FROM v
WHERE list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0)) >= 0 ORDER BY 2 DESC, 1 LIMIT 10""")
def semantic_topk(spark, sf):
    v = read(spark, sf, "embeddings")
    q = v.where("vec_id = 0").first()["embedding"]
    return search.semantic_search(v, q, search.SearchConfig(), ties=("vec_id",)).select("vec_id", r6(F.col("similarity")).alias("similarity"))


@query(V + """, p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS s FROM v q, v c WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")
def batch_topk(spark, sf):
    v = read(spark, sf, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.batch_search(v, asked, 5, "vec_id").withColumn("similarity", r6(F.col("similarity")))


@query(V + """, p AS (SELECT q.vec_id AS q, q.label AS ql, c.label AS cl, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, c.e) DESC, c.vec_id) AS r FROM v q, v c WHERE c.vec_id <> q.vec_id),
e AS (SELECT q, count(*) FILTER (cl = ql) AS f, min(r) FILTER (cl = ql) AS first FROM p WHERE r <= 10 GROUP BY q),
k AS (SELECT a.vec_id AS q, count(*) AS n FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1)
SELECT round(avg(f / 10.0), 6) AS precision, round(avg(f::DOUBLE / n), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, 0.0::DOUBLE AS zero_result_rate, 10.0::DOUBLE AS avg_results FROM e JOIN k USING (q)""")
def knn_label_precision(spark, sf):
    """Every vector is asked for; those whose label no other has find nothing relevant and don't count."""
    v = read(spark, sf, "embeddings")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = search.batch_search(v, asked, 11, "vec_id").where("vec_id <> query_id")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 10").select(F.col("query_id").alias("query"), F.col("vec_id").alias("doc"), "rank")
    made = search.evaluation(search.evaluated_by_label(ranked, v.select(F.col("vec_id").alias("doc"), "label"), 10, alone=False))
    return made.select(*[r6(F.col(c)).alias(c) for c in made.columns])


@query(V + " SELECT vec_id, label, round(list_cosine_similarity(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)), 6) AS similarity FROM v")
def pairwise_similarity(spark, sf):
    return chunking.adjacent(read(spark, sf, "embeddings"), "label", "vec_id").select("vec_id", "label", r6(F.col("similarity")).alias("similarity"))


@query(V + """, s AS (SELECT label, vec_id, list_cosine_similarity(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)) AS s FROM v),
l AS (SELECT label, list(s ORDER BY vec_id) FILTER (s IS NOT NULL) AS s FROM s GROUP BY label)
SELECT label, unnest(list_concat([0], list_filter(range(1, len(s) + 1), lambda i: s[i] < least(list_sort(s)[round(0.5 * (len(s) - 1))::INTEGER + 1], 0.7)))) AS boundary FROM l""")
def boundary_flags(spark, sf):
    each = chunking.adjacent(read(spark, sf, "embeddings"), "label", "vec_id")
    limits = chunking.long_limits(each.select("label", "similarity"), chunking.ChunkerConfig(), "label")
    below = each.join(limits, "label").where(F.col("similarity") < F.col("limit")).select("label", F.col("number").alias("boundary"))
    return below.unionByName(each.where("number = 0").select("label", F.col("number").alias("boundary")))


@query("""SELECT label, (k - 1)::INTEGER AS k, round(avg(x), 6) AS mean FROM
  (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY label, k""")
def centroid(spark, sf):
    each = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    return each.groupBy("label", "k").agg(r6(F.avg(F.col("x").cast("double"))).alias("mean"))


#: The walk over boundaries written out: the next beginning is the first boundary three or more after the last one.
CHUNKS_SQL = SENTENCES_SQL.replace("WITH s AS", "WITH RECURSIVE s AS") + """,
t AS MATERIALIZED (SELECT doc_id, k, s[k + 1] AS s, list_transform(range(1, 65), lambda i: (ascii(substr(sha256(s[k + 1]), i, 1)) / 255.0::DOUBLE)::FLOAT) AS e FROM s, unnest(range(len(s))) u(k)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
p AS MATERIALIZED (SELECT b.doc_id, b.k, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS sim FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
l AS (SELECT doc_id, least(list_sort(list(sim))[round(0.5 * (count(*) - 1))::INTEGER + 1], 0.7) AS lim FROM p GROUP BY 1),
c AS MATERIALIZED (SELECT doc_id, k FROM p JOIN l USING (doc_id) WHERE sim < lim),
g AS (SELECT doc_id, 0::BIGINT AS start FROM n UNION ALL SELECT g.doc_id, min(c.k) FROM g JOIN c ON c.doc_id = g.doc_id AND c.k >= g.start + 3 GROUP BY g.doc_id, g.start),
h AS (SELECT doc_id, start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM g),
q AS (SELECT doc_id, start AS first, stop - 1 AS last FROM h WHERE stop - start <= 30
  UNION ALL SELECT doc_id, f, least(f + 30, stop) - 1 FROM h, unnest(range(start, stop, 30)) u(f) WHERE stop - start > 30 AND least(f + 30, stop) - f >= 3),
r AS (SELECT *, last AS core, row_number() OVER (PARTITION BY doc_id ORDER BY first DESC) = 1 AS final FROM q),
e AS (SELECT doc_id, start, n FROM h JOIN n USING (doc_id) WHERE stop IS NULL),
x AS (SELECT r.doc_id, first, CASE WHEN final AND n - start < 3 THEN n - 1 ELSE last END AS last, core FROM r JOIN e USING (doc_id) UNION ALL SELECT doc_id, start, n - 1, n - 1 FROM e WHERE n - start >= 3),
y AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, first, last, core FROM x),
m AS (SELECT y.doc_id, chunk_index, total_chunks, first, last, string_agg(s, ' ' ORDER BY k) AS content FROM y JOIN t ON t.doc_id = y.doc_id AND k BETWEEN first AND last GROUP BY ALL),
v AS (SELECT doc_id, chunk_index, list(d ORDER BY i) AS v FROM (SELECT y.doc_id, chunk_index, i, round(avg(e[i]::DOUBLE) * 10000)::BIGINT AS d FROM y JOIN t ON t.doc_id = y.doc_id AND k BETWEEN first AND core, unnest(range(1, 65)) u(i) GROUP BY ALL) GROUP BY ALL),
w AS (SELECT y.doc_id, chunk_index, avg(sim) AS sim FROM y LEFT JOIN p ON p.doc_id = y.doc_id AND k > first AND k <= core GROUP BY ALL)
SELECT doc_id, chunk_index::INTEGER AS chunk_index, total_chunks::INTEGER AS total_chunks, first::INTEGER AS start_sentence, last::INTEGER AS end_sentence, (last - first + 1)::INTEGER AS sentences, md5(content) AS content,
  md5(array_to_string(v, ',')) AS embedding, length(content)::INTEGER AS char_count, round(coalesce(sim, 1.0::DOUBLE), 6) AS avg_similarity FROM m JOIN v USING (doc_id, chunk_index) JOIN w USING (doc_id, chunk_index)"""


@query(CHUNKS_SQL)
def semantic_chunks(spark, sf):
    """Chunks of all documents, with the hash stand-in for a model."""
    made = chunking.chunk_documents(read(spark, sf, "documents"), chunking.ChunkerConfig(), size=64)
    return chunk_columns(made)


@query(CHUNKS_SQL)
def semantic_chunks_long(spark, sf):
    """The same without a row that holds a document: boundaries spaced over ranges of sentences."""
    return chunk_columns(chunking.chunk_documents(read(spark, sf, "documents"), chunking.ChunkerConfig(), size=64, long=True))


def chunk_columns(made):
    parts = F.transform("embedding", lambda x: F.round(x * 10000).cast("long").cast("string"))
    return made.select(
        "doc_id", "chunk_index", "total_chunks", "start_sentence", "end_sentence", chunking.sentence_count(F.col("start_sentence"), F.col("end_sentence")).alias("sentences"), F.md5(F.col("content").cast("binary")).alias("content"),
        F.md5(F.array_join(parts, ",").cast("binary")).alias("embedding"), "char_count", r6(F.col("avg_similarity")).alias("avg_similarity"),
    )


@query("""SELECT doc_id, CASE WHEN p LIKE '%tutorial%' THEN 'tutorial' WHEN p LIKE '%howto%' OR p LIKE '%how-to%' OR p LIKE '%how\\_to%' ESCAPE '\\' THEN 'how-to'
 WHEN p LIKE '%reference%' OR p LIKE '%api%' THEN 'reference' WHEN p LIKE '%explanation%' OR p LIKE '%concept%' THEN 'explanation' END AS category
 FROM (SELECT doc_id, lower((['docs/Tutorial/a', 'docs/how_to/b', 'API/c', 'Concepts/d', 'misc/e'])[doc_id % 5 + 1]) AS p FROM documents)""")
def path_categories(spark, sf):
    paths = F.array(*map(F.lit, ["docs/Tutorial/a", "docs/how_to/b", "API/c", "Concepts/d", "misc/e"]))
    p = F.element_at(paths, (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", quality.path_category(p).alias("category"))


# -- analytics ---------------------------------------------------------------

USAGE_SQL = """count(*) AS total_queries, count(DISTINCT session_id) AS unique_sessions, count(DISTINCT user_id) AS unique_users,
  coalesce(sum(zero_results::INT), 0)::BIGINT AS zero_result_queries, round(coalesce(avg(result_count), 0), 6) AS avg_results, round(coalesce(avg(execution_time_ms), 0), 6) AS avg_execution_ms"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(EV + f" SELECT {USAGE_SQL} FROM ev WHERE type = 'query'")
def usage_summary(spark, sf):
    return rounded(analytics.usage(search_events(spark, sf)))


@query(EV + f" SELECT query_type, strftime(ts, '%Y-%m-%d') AS day, {USAGE_SQL} FROM ev WHERE type = 'query' GROUP BY ROLLUP (query_type, day)")
def usage_rollup(spark, sf):
    e = search_events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(analytics.usage_rollup(e, "query_type", "day"))


@query(EV + """, c AS (SELECT DISTINCT query_id FROM ev WHERE type = 'click')
SELECT query, count(*) AS count, round(avg(result_count), 6) AS avg_results, round(avg(CASE WHEN c.query_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS click_through_rate
FROM ev LEFT JOIN c USING (query_id) WHERE type = 'query' GROUP BY query ORDER BY 2 DESC, 1 LIMIT 10""")
def popular_queries(spark, sf):
    return rounded(analytics.popular(search_events(spark, sf)))


@query(EV + " SELECT query_type, count(*) AS count FROM ev WHERE type = 'query' GROUP BY 1")
def type_distribution(spark, sf):
    return analytics.by_type(search_events(spark, sf))


@query(EV + " SELECT query, query_id FROM ev WHERE type = 'query' AND zero_results ORDER BY ts, query_id LIMIT 20")
def zero_result_examples(spark, sf):
    return analytics.without_results(search_events(spark, sf)).select("query", "query_id")


QUALITY_SQL = """, a AS (SELECT {by} count(*) FILTER (type = 'query') AS queries, count(*) FILTER (type = 'click') AS clicks,
  coalesce(avg(position) FILTER (type = 'click'), 0) AS avg_click_position, coalesce(avg(time_to_click_ms) FILTER (type = 'click'), 0) AS avg_time_to_click_ms,
  count(DISTINCT query_id) FILTER (type = 'click') AS clicked, count(DISTINCT session_id) FILTER (type = 'query') AS sessions,
  coalesce(avg(duration_ms) FILTER (type = 'session_end'), 0) AS avg_session_ms FROM ev {group}),
b AS (SELECT *, clicks::DOUBLE / queries AS ctr, clicked::DOUBLE / queries AS cl FROM a)
SELECT {by} queries, clicks, round(avg_click_position, 6) AS avg_click_position, round(avg_time_to_click_ms, 6) AS avg_time_to_click_ms, round(avg_session_ms, 6) AS avg_session_ms,
  round(ctr, 6) AS click_through_rate, round(cl, 6) AS queries_with_clicks, round(queries::DOUBLE / sessions, 6) AS queries_per_session,
  round(greatest(0, least(1, 0.4 * ctr + 0.3 * CASE WHEN avg_click_position <= 0 THEN 1 ELSE greatest(0, 1 - least(avg_click_position / 10, 1)) END + 0.3 * cl))::DOUBLE, 6) AS relevance FROM b"""


@query(EV + QUALITY_SQL.format(by="", group=""))
def quality_metrics(spark, sf):
    return rounded(analytics.quality(search_events(spark, sf)))


@query(EV + QUALITY_SQL.format(by="query_type,", group="GROUP BY query_type"))
def quality_by_type(spark, sf):
    return rounded(analytics.quality(search_events(spark, sf), "query_type"))


@query(EV + f" SELECT {USAGE_SQL} FROM ev WHERE type = 'query' AND ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND (SELECT max(ts) FROM events)")
def period_usage(spark, sf):
    now = F.lit(read(spark, sf, "events").agg(F.max("ts")).first()[0])
    return rounded(analytics.usage(analytics.within(search_events(spark, sf), "week", now)))


# -- search ------------------------------------------------------------------


@query("""SELECT p_partkey, score FROM (SELECT p_partkey, (CASE WHEN list_has_any(regexp_split_to_array(lower(p_name), '[^a-z0-9_-]+'), ['red', 'steel']) THEN 2.0 ELSE 0 END
 + CASE WHEN list_has_any(regexp_split_to_array(lower(p_type), '[^a-z0-9_-]+'), ['red', 'steel']) THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM part) WHERE score > 0""")
def multi_match(spark, sf):
    m = search.MultiMatch("red steel", ("p_name", "p_type"), {"p_name": 2.0}, ("p_name", "p_type"))
    return read(spark, sf, "part").withColumn("score", m.score()).where("score > 0").select("p_partkey", "score")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000 AND NOT o_orderpriority = '1-URGENT'
 AND (o_totalprice <= 50000)::INT + (o_custkey <= 100)::INT + (o_orderpriority = '2-HIGH')::INT >= 1""")
def bool_query(spark, sf):
    q = search.BoolQuery((search.Term("o_orderstatus", "F"), search.Range("o_totalprice", 1000.0, 200000.0)), (search.Range("o_totalprice", None, 50000.0), search.Range("o_custkey", None, 100), search.Term("o_orderpriority", "2-HIGH")), (search.Term("o_orderpriority", "1-URGENT"),), 1)
    return read(spark, sf, "orders").where(q.column()).select("o_orderkey")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate FROM orders), p AS (SELECT * FROM o ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 99)
SELECT o.o_orderkey FROM o, p WHERE (o.o_orderdate, o.o_orderkey) < (p.o_orderdate, p.o_orderkey) ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 25""")
def keyset_page(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    last = o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).tail(1)[0]
    after = search.cursor(last["o_orderkey"], last["o_orderdate"].isoformat(sep=" "))
    return search.keyset_page(o, 25, after, "o_orderkey", "o_orderdate").select("o_orderkey")


@query("""SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20 OFFSET 40""")
def offset_page(spark, sf):
    r = search.Request(bool_query=search.BoolQuery((search.Term("o_orderstatus", "O"),)), options=search.Options(20, 40, snippets=False))
    return r.run(read(spark, sf, "orders"), "o_orderkey").select("o_orderkey", F.col("total").cast("long").alias("total"))


FOUND_SQL = V + f""", s AS (SELECT vec_id, (list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0)) + 1) / 2 AS similarity FROM v),
f AS (SELECT vec_id, similarity, {CATEGORY_SQL.format('vec_id')} AS category, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (vec_id % 90) AS updated_at FROM s)"""


def found(spark, sf):
    v = read(spark, sf, "embeddings")
    q = v.where("vec_id = 0").first()["embedding"]
    s = (vx.cosine(F.col("embedding"), F.array(*map(F.lit, q))) + 1) / 2
    return v.select("vec_id", s.alias("similarity"), CATEGORY(F.col("vec_id")).alias("category"), F.timestamp_seconds(F.lit(1704067200) + 86400 * (F.col("vec_id") % 90)).alias("updated_at"))


@query(FOUND_SQL + """ SELECT 'category' AS facet, category AS value, count(*) AS count FROM f GROUP BY 2
UNION ALL SELECT 'similarity', CASE WHEN similarity >= 0.8 THEN 'high' WHEN similarity >= 0.6 THEN 'medium' ELSE 'low' END, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'month', strftime(updated_at, '%Y-%m'), count(*) FROM f GROUP BY 2""")
def facets(spark, sf):
    return search.facets(found(spark, sf))


@query(FOUND_SQL + " SELECT vec_id FROM f WHERE category IN ('tutorial', 'reference') AND similarity BETWEEN 0.5 AND 0.9 AND updated_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-02-20'")
def filtered_search(spark, sf):
    import datetime as dt

    f = search.Filters(("Tutorial", "reference"), (0.5, 0.9), (dt.datetime(2024, 1, 10), dt.datetime(2024, 2, 20)))
    return found(spark, sf).where(f.column()).select("vec_id")


# -- keywords and quality ----------------------------------------------------

ASCII_TOKENS = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_-]+')"


@query(f"SELECT doc_id, word, count(*) AS count FROM (SELECT doc_id, unnest({ASCII_TOKENS}) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2")
def term_frequency(spark, sf):
    return keywords.term_frequencies(read(spark, sf, "documents"), "doc_id", "text")


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in keywords.STOP_WORDS) + ")"


@query(f"""WITH t AS (SELECT doc_id, word, count(*) AS count FROM (SELECT doc_id, unnest({ASCII_TOKENS}) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2),
s AS (SELECT *, round(count * ln(strlen(word)), 9) AS score FROM t WHERE word NOT IN {STOP_SQL} AND strlen(word) > 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM s),
c AS (SELECT *, CASE WHEN regexp_matches(word, '[_.-]|(rs|toml|yaml|json)$|^(cargo|rust|async)') OR strlen(word) > 12 THEN 'technical' ELSE 'descriptive' END AS class FROM r WHERE rank <= 18),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, class ORDER BY rank) AS place FROM c)
SELECT doc_id, word, count, round(score, 6) AS score, class, rank::INTEGER AS rank FROM p WHERE place <= CASE class WHEN 'technical' THEN 10 ELSE 8 END""")
def keywords_topk(spark, sf):
    return rounded(keywords.keywords(read(spark, sf, "documents"), "doc_id", "text"))


READ_SQL = """CASE WHEN n = 0 THEN 0 ELSE least(1 - least(n / greatest(length(text) - length(translate(text, '.!?', '')), 1)::DOUBLE / 50, 1) + CASE WHEN contains(text, '##') OR contains(text, '- ') THEN 0.1 ELSE 0 END, 1) END::DOUBLE"""
STRUCT_SQL = """(contains(text, '# ')::INT + contains(text, '## ')::INT + contains(text, '```')::INT + (contains(text, '- ') OR contains(text, '1. '))::INT + (contains(text, '[') AND contains(text, ']('))::INT) / 5.0::DOUBLE"""
DOCS_N = "(SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)"


@query(f"SELECT doc_id, round({READ_SQL}, 6) AS readability, round({STRUCT_SQL}, 6) AS structure FROM {DOCS_N}")
def readability(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", r6(quality.readability(t)).alias("readability"), r6(quality.structure(t)).alias("structure"))


LINT_SQL = """l AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS ls FROM documents),
x AS (SELECT doc_id, coalesce(len(list_filter(ls, lambda x: contains(x, '](') AND length(replace(x, '[', '')) <> length(replace(x, ']', '')))), 0) AS errors,
  coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '^#+\\s*$'))), 0) AS warnings, coalesce(len(list_filter(ls, lambda x: strlen(x) > 120)), 0) AS infos FROM l)"""


def lint_table(spark, sf):
    d = read(spark, sf, "documents").withColumn("issues", quality.lint(F.col("text")))
    n = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s)).cast("long")
    return d.withColumn("errors", n("error")).withColumn("warnings", n("warning")).withColumn("infos", n("info"))


@query(f"WITH {LINT_SQL} SELECT * FROM x")
def lint_counts(spark, sf):
    return lint_table(spark, sf).select("doc_id", "errors", "warnings", "infos")


@query(f"""WITH {LINT_SQL}, d AS (SELECT *, {READ_SQL} AS r, {STRUCT_SQL} AS s FROM {DOCS_N})
SELECT doc_id, round(greatest((r + s) / 2 - 0.3 * errors - 0.1 * warnings, 0)::DOUBLE, 6) AS score FROM d JOIN x USING (doc_id)""")
def doc_score(spark, sf):
    t = F.col("text")
    return lint_table(spark, sf).select("doc_id", r6(quality.document_score(quality.readability(t), quality.structure(t), F.col("errors"), F.col("warnings"))).alias("score"))


@query("""SELECT doc_id, CASE WHEN contains(t, 'step by step') OR contains(t, 'tutorial') THEN 'tutorial' WHEN contains(t, 'how to') OR contains(t, 'guide') THEN 'how-to'
 WHEN contains(t, 'api') OR contains(t, 'reference') THEN 'reference' WHEN contains(t, 'why') OR contains(t, 'explanation') THEN 'explanation' END AS category FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def content_category(spark, sf):
    return read(spark, sf, "documents").select("doc_id", quality.document_category(F.lit("x.md"), F.col("text")).alias("category"))


ANSWER_SQL = f"""
WITH a AS (SELECT doc_id, text AS t, lower(text) AS low, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) END AS ls,
  list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, t, low, ls, len(list_filter(ls, lambda x: starts_with(x, '#'))) AS heads, (length(t) - length(replace(t, '```', ''))) // 3 // 2 AS fences,
  len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*]'))) AS items, len(list_filter(string_split(t, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S'))) AS paras,
  list_filter(string_split(t, '.'), lambda x: regexp_matches(x, '\\S')) AS sents, len(ws) AS n, len(list_filter(ws, lambda w: strlen(w) > 12)) AS long_n,
  coalesce(regexp_replace(ls[len(ls)], '^\\s+|\\s+$', '', 'g'), '') AS last FROM a),
g AS (SELECT *, list_avg(list_transform(sents, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')))) AS per, CASE WHEN n > 0 THEN long_n / n::DOUBLE END AS longs FROM f),
s AS (SELECT doc_id, t, low, ls, last, strlen(t) AS bytes,
  CASE WHEN strlen(t) < 800 THEN strlen(t) / 800.0::DOUBLE WHEN strlen(t) > 8000 THEN greatest(1.0 - 0.5 * (strlen(t) - 8000) / 8000.0::DOUBLE, 0.3) ELSE 1.0 END::DOUBLE AS length,
  CASE WHEN (heads > 0)::INT + (fences > 0)::INT + (items > 0)::INT + (paras > 0)::INT = 0 THEN 0.3 ELSE (CASE WHEN heads >= 3 THEN 1.0 WHEN heads > 0 THEN 0.5 + heads * 0.25 ELSE 0 END + CASE WHEN fences >= 2 THEN 1.0 WHEN fences > 0 THEN 0.7 ELSE 0 END
    + CASE WHEN items >= 5 THEN 1.0 WHEN items > 0 THEN 0.7 ELSE 0 END + CASE WHEN paras >= 3 THEN 1.0 WHEN paras > 0 THEN 0.5 ELSE 0 END)::DOUBLE / ((heads > 0)::INT + (fences > 0)::INT + (items > 0)::INT + (paras > 0)::INT) END::DOUBLE AS structure,
  ({" + ".join(f"contains(low, '{w}')::INT" for w in quality.EXPECTED["reference"])}) / {len(quality.EXPECTED["reference"])}.0::DOUBLE AS completeness, 0.7::DOUBLE AS code,
  (CASE WHEN per IS NULL THEN 0 WHEN per < 10 THEN 0.7 WHEN per > 35 THEN 0.5 WHEN per BETWEEN 15 AND 25 THEN 1.0 ELSE 0.8 END + CASE WHEN longs IS NULL THEN 0 WHEN longs > 0.15 THEN 0.6 WHEN longs < 0.05 THEN 0.9 ELSE 1.0 END
    + CASE WHEN {" OR ".join(f"contains(low, '{w}')" for w in quality.TRANSITIONS)} THEN 1.0 ELSE 0.6 END)::DOUBLE / (1 + (per IS NOT NULL)::INT + (longs IS NOT NULL)::INT) AS clarity FROM g),
o AS (SELECT *, length * 0.15::DOUBLE + structure * 0.25::DOUBLE + completeness * 0.3::DOUBLE + code * 0.2::DOUBLE + clarity * 0.1::DOUBLE AS overall FROM s)
SELECT doc_id, round(length, 9) AS length, round(structure, 9) AS structure, round(completeness, 9) AS completeness, round(code, 9) AS code, round(clarity, 9) AS clarity,
  list_filter([CASE WHEN bytes < 100 THEN 'short' END, CASE WHEN NOT regexp_matches(t, '\\S') THEN 'blank' END,
    CASE WHEN (last <> '' AND NOT regexp_matches(last, '([.!?]|```)$')) OR regexp_matches(lower(last), '(\\.\\.\\.|and|but|or|the|a|an)$') THEN 'incomplete' END], lambda x: x IS NOT NULL) AS issues,
  list_filter([CASE WHEN bytes > 50000 THEN 'long' END, CASE WHEN {" OR ".join(f"contains(t, '{w}')" for w in quality.PLACEHOLDERS)} THEN 'placeholder' END,
    CASE WHEN {" OR ".join("contains(low, '" + w.replace("'", "''") + "')" for w in quality.UNSURE)} THEN 'unsure' END,
    CASE WHEN len(ls) >= 5 AND len(list_filter(range(3, len(ls) + 1), lambda i: ls[i] = ls[i - 1] AND ls[i] = ls[i - 2])) > 0 THEN 'repetition' END], lambda x: x IS NOT NULL) AS warnings,
  round(overall, 9) AS overall, CASE WHEN overall >= 0.8 THEN 'high' WHEN overall >= 0.6 THEN 'medium' WHEN overall >= 0.4 THEN 'low' ELSE 'very_low' END AS level FROM o"""


@query(ANSWER_SQL)
def answer_confidence(spark, sf):
    """Five scores of documents taken as answers of type reference, with issues and warnings (no text has a fence: code is constant)."""
    return rounded(quality.answer_scores(read(spark, sf, "documents"), "reference"), 9)


@query("""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents)
SELECT doc_id, len(ls) >= 5 AND len(list_filter(range(3, len(ls) + 1), lambda i: ls[i] = ls[i - 1] AND ls[i] = ls[i - 2])) > 0 AS repeats FROM l""")
def repeated_lines(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.coalesce(quality.repeats_lines(F.col("text")), F.lit(False)).alias("repeats"))


@query("""SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
FROM (SELECT doc_id, (doc_id % 4) / (doc_id % 4 + 2)::DOUBLE AS p, CASE WHEN doc_id % 4 + doc_id % 3 > 0 THEN (doc_id % 4) / (doc_id % 4 + doc_id % 3)::DOUBLE ELSE 0 END AS r FROM labels)""")
def keyword_feedback(spark, sf):
    rep = lambda n: F.array_repeat(F.lit("w"), n.cast("int"))
    p, r, f = quality.keyword_scores(rep(F.col("doc_id") % 4 + 2), rep(F.col("doc_id") % 4), rep(F.col("doc_id") % 3))
    return read(spark, sf, "labels").select("doc_id", r6(p).alias("precision"), r6(r).alias("recall"), r6(f).alias("f1"))


@query("SELECT DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM benchmark")
def normal_queries(spark, sf):
    return read(spark, sf, "benchmark").select(tx.normal_query(F.col("text")).alias("key")).distinct()


# -- intents, prompts, stores --------------------------------------------------

NAMES = ["Tutorial", "how-to", "API", "concepts", "guide", "nonsense", "", "tutorials", "reference"]
NAMES_SQL = "(['Tutorial', 'how-to', 'API', 'concepts', 'guide', 'nonsense', '', 'tutorials', 'reference'])[{} % 9 + 1]"


def intent_sql(name: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({name}) IN ({', '.join(repr(n) for n in names)}) THEN '{i}'" for i, names in intents.ALIASES.items()) + " END"


#: Answers in the form that a model is asked for, some with faults; ``\w+`` ends a name at a hyphen.
@query(f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'a how to of sorts' ELSE 'Intent: ' || {NAMES_SQL.format('doc_id')} || chr(10) || 'Confidence: ' || CASE WHEN doc_id % 7 = 0 THEN 'none' ELSE (doc_id % 13 / 10.0)::DECIMAL(3, 1)::VARCHAR END
  || chr(10) || 'Reasoning: it is ' || lang || chr(10) || 'Secondary: ' || {NAMES_SQL.format('(doc_id + 3)')} || ':0.8, explanation:' || (doc_id % 10 / 10.0)::DECIMAL(3, 1) || ', x' END AS t FROM documents),
p AS (SELECT doc_id, t, regexp_extract(t, '(?i)Intent:\\s*(\\w+)', 1) AS said, regexp_extract(t, '(?i)Confidence:\\s*([0-9.]+)', 1) AS conf, regexp_extract(t, '(?i)Reasoning:\\s*(.+?)(?:\\n|$)', 1) AS why,
  regexp_extract(t, '(?i)Secondary:\\s*(.+?)(?:\\n|$)', 1) AS sec FROM a),
q AS (SELECT *, CASE WHEN said <> '' THEN {intent_sql('said')} WHEN contains(lower(t), 'tutorial') THEN 'tutorial' WHEN contains(lower(t), 'howto') OR contains(lower(t), 'how-to') OR contains(lower(t), 'how to') THEN 'howto'
  WHEN contains(lower(t), 'reference') THEN 'reference' WHEN contains(lower(t), 'explanation') THEN 'explanation' END AS intent, least(greatest(coalesce(TRY_CAST(conf AS DOUBLE), 0.7), 0), 1)::DOUBLE AS confidence FROM p)
SELECT doc_id, intent, confidence, CASE WHEN why <> '' THEN trim(why) ELSE trim(t) END AS reasoning,
  coalesce(array_to_string(list_filter(list_transform(string_split(sec, ','), lambda x: CASE WHEN {intent_sql("trim(string_split(trim(x), ':')[1])")} IS NOT NULL AND TRY_CAST(trim(string_split(trim(x), ':')[2]) AS DOUBLE) >= 0.6 THEN {intent_sql("trim(string_split(trim(x), ':')[1])")} END), lambda x: x IS NOT NULL), ','), '') AS secondary,
  CASE WHEN said <> '' AND intent IS NULL THEN 'invalid_intent' WHEN intent IS NULL THEN 'parse_error' WHEN confidence < 0.6 THEN 'low_confidence' END AS error FROM q""")
def intent_answers(spark, sf):
    d, at = read(spark, sf, "documents"), lambda k: F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(F.col("doc_id") + k, F.lit(9)) + 1).cast("int"))
    tenth = lambda n: (F.col("doc_id") % n / 10).cast("decimal(3,1)").cast("string")
    confidence = F.when(F.col("doc_id") % 7 == 0, "none").otherwise(tenth(13))
    answer = F.concat(F.lit("Intent: "), at(0), F.lit("\nConfidence: "), confidence, F.lit("\nReasoning: it is "), F.col("lang"), F.lit("\nSecondary: "), at(3), F.lit(":0.8, explanation:"), tenth(10), F.lit(", x"))
    parsed = d.select("doc_id", intents.parsed(F.when(F.col("doc_id") % 10 == 9, "a how to of sorts").otherwise(answer), multi=True).alias("p"))
    return parsed.select("doc_id", "p.intent", "p.confidence", "p.reasoning", F.array_join(F.transform("p.secondary", lambda x: x["intent"]), ",").alias("secondary"), "p.error")


SIGN_COUNTS = ", ".join("(" + " + ".join(f"contains(low, '{w}')::INT" for w in signs) + f") AS {i}" for i, signs in intents.SIGNS.items())


@query(f"""WITH c AS (SELECT conv_id, turn, text, trim(text, ' ' || chr(9) || chr(10)) = '' AS blank, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low0 FROM conversations),
h AS (SELECT conv_id, turn, blank, {SIGN_COUNTS} FROM (SELECT *, lower(text) AS low FROM c)),
m AS (SELECT *, tutorial + howto + reference + explanation AS total, greatest(tutorial, howto, reference, explanation) AS most FROM h)
SELECT conv_id, turn, CASE WHEN blank THEN NULL WHEN total = 0 THEN 'explanation' WHEN tutorial = most THEN 'tutorial' WHEN howto = most THEN 'howto' WHEN reference = most THEN 'reference' ELSE 'explanation' END AS intent,
  CASE WHEN blank THEN 'empty_query' WHEN total = 0 OR round(0.5 + 0.4 * most / total, 2) < 0.6 THEN 'low_confidence' END AS error FROM m""")
def intent_rules(spark, sf):
    """Every turn as a question, judged by rules."""
    return intents.classified(read(spark, sf, "conversations"), "text").select("conv_id", "turn", "intent", "error")


TOKENS_SQL = "ceil(strlen(text) / 4.0::DOUBLE * 1.3::DOUBLE)::BIGINT"


@query(f"""SELECT conv_id, 600::BIGINT AS total, 512::BIGINT AS available, sum({TOKENS_SQL})::BIGINT AS used, greatest(512 - sum({TOKENS_SQL}), 0)::BIGINT AS remaining, sum({TOKENS_SQL}) <= 512 AS within_limit, array_to_string(list({TOKENS_SQL} ORDER BY turn), ',') AS parts FROM conversations GROUP BY 1""")
def prompt_budgets(spark, sf):
    made = prompts.budgets(read(spark, sf, "conversations"), "conv_id", "turn", most=600, reserved=88)
    return made.withColumn("parts", F.array_join(F.transform("parts", lambda x: x["tokens"].cast("string")), ","))


@query(f"""WITH t AS (SELECT conv_id, turn, text, {TOKENS_SQL} AS tokens, sum({TOKENS_SQL}) OVER (PARTITION BY conv_id) <= 512 AS whole FROM conversations),
r AS (SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY CASE WHEN NOT whole THEN turn END DESC NULLS LAST, turn ROWS UNBOUNDED PRECEDING))::BIGINT AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN NOT whole THEN turn END DESC NULLS LAST, turn) - 1 AS place FROM t),
k AS (SELECT *, spent > 512 AS cut, floor((512 - spent + tokens) * 4 / 1.3::DOUBLE)::INT AS chars FROM r WHERE spent <= 512 OR (spent - tokens <= 512 AND 512 - spent + tokens > 100)),
h AS (SELECT *, left(text, chars) AS head FROM k), z AS (SELECT *, strpos(reverse(head), '.') AS dot, strpos(reverse(head), ' ') AS gap FROM h)
SELECT conv_id, turn, place::INT AS place, tokens, least(spent, 512)::BIGINT AS spent, cut, md5(CASE WHEN NOT cut THEN text WHEN dot > 0 AND length(head) - dot + 1 > chars // 2 THEN left(head, length(head) - dot + 1) WHEN gap > 0 THEN left(head, length(head) - gap) ELSE head END) AS digest FROM z""")
def prompt_packing(spark, sf):
    """Turns of a conversation that fit 512 tokens, the latest first, the first that doesn't cut to fit."""
    fit = prompts.fitted(read(spark, sf, "conversations"), "conv_id", "turn", "turn", most=600, reserved=88)
    return fit.withColumn("text", F.md5(F.col("text").cast("binary"))).withColumnRenamed("text", "digest").withColumn("spent", F.col("spent").cast("long"))


@query("""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS n, 0 AS start, CASE WHEN length(text) <= 1000 THEN length(text) ELSE {cut} END AS stop FROM (SELECT doc_id, text, 0 AS s FROM documents WHERE length(text) > 0)
  UNION ALL SELECT doc_id, text, n + 1, s, CASE WHEN s + 1000 >= length(text) THEN length(text) ELSE {cut} END FROM (SELECT doc_id, text, n, greatest(stop - 50, start + 1) AS s FROM c WHERE stop < length(text)))
SELECT doc_id, n, length(substr(text, start + 1, stop - start)) AS chars, md5(substr(text, start + 1, stop - start)) AS digest FROM c""".format(
    cut="""CASE WHEN strpos(reverse(substr(text, s + 1, 1000)), chr(10) || chr(10)) BETWEEN 1 AND 498 THEN s + 1000 - strpos(reverse(substr(text, s + 1, 1000)), chr(10) || chr(10)) - 1
    WHEN strpos(reverse(substr(text, s + 1, 1000)), '.') > 0 THEN s + 1000 - strpos(reverse(substr(text, s + 1, 1000)), '.') + 1 ELSE s + 1000 END"""
))
def context_chunks(spark, sf):
    each = read(spark, sf, "documents").select("doc_id", F.posexplode(tx.context_chunks(F.col("text"), 1000, 50)).alias("n", "piece"))
    return each.select("doc_id", "n", F.length("piece").alias("chars"), F.md5(F.col("piece").cast("binary")).alias("digest"))


@query(STATES + """ SELECT file_path, content, chunk_index, total_chunks, hash FROM (SELECT x.path AS file_path, md5(CASE WHEN action = 'update' OR action = 'add' AND doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content,
  0 AS chunk_index, 1 AS total_chunks, CASE WHEN action IN ('add', 'update') THEN c.h ELSE e.h END AS hash FROM x LEFT JOIN c USING (path) LEFT JOIN e USING (path) JOIN documents ON x.path = 'doc/' || doc_id WHERE doc_id % 13 <> 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')""")
def chunk_store(spark, sf):
    """A chunk store after a first ingest, a second one that skips, updates and adds, and a deletion."""
    d = read(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "doc_id", "text")
    store = ingest.chunk_store(spark, scratch(spark), buckets=8)
    ingest.ingest(d.where("doc_id % 11 <> 0").select("file_path", "text"), store, None)
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    ingest.ingest(d.where("doc_id % 7 <> 0").select("file_path", changed.alias("text")), store, None)
    store.replace(spark.createDataFrame([], ingest.CHUNKS), d.where("doc_id % 13 = 0").select("file_path"))
    return store.read().select("file_path", F.md5(F.col("content").cast("binary")).alias("content"), "chunk_index", "total_chunks", F.col("file_hash").alias("hash"))


@query(f"""WITH {LINT_SQL}, d AS (SELECT *, {READ_SQL} AS r, {STRUCT_SQL} AS s FROM {DOCS_N})
SELECT count(*) AS documents, round(avg(greatest((r + s) / 2 - 0.3 * errors - 0.1 * warnings, 0)::DOUBLE), 6) AS score, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings FROM d JOIN x USING (doc_id)""")
def directory_score(spark, sf):
    t = F.col("text")
    scored = lint_table(spark, sf).withColumn("score", quality.document_score(quality.readability(t), quality.structure(t), F.col("errors"), F.col("warnings")))
    return rounded(quality.directory_score(scored))


@query("""SELECT count(*) FILTER (event_type = 'view') AS buffer_size, count(*) AS total_events, count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS total_flushed, count(*) FILTER (event_type = 'error') AS total_errors FROM events""")
def collector_stats(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").isin("click", "purchase", "signup").alias("flushed"), (F.col("event_type") == "error").alias("failed"))
    return monitoring.collector(e)


@query("""SELECT count(DISTINCT user_id) AS connections, count(CASE WHEN event_type <> 'view' THEN event_id END) AS subscriptions FROM events""")
def connection_stats(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("connection_id"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("subscription_id"))
    return monitoring.connections(e)


# -- cross-references, indexes -----------------------------------------------


@query(f"""WITH d AS (SELECT 'doc ' || doc_id AS title, {CATEGORY_SQL.format('doc_id')} AS category FROM documents),
r(a, b, relationship) AS (VALUES {', '.join(str(x) for x in crossref.RULES)}),
n AS (SELECT category, count(*) AS n FROM d GROUP BY 1), m AS (SELECT title, category, count(*) AS n FROM d GROUP BY 1, 2)
SELECT f.title AS from_title, a AS from_category, b AS to_category, relationship, CASE b WHEN 'tutorial' THEN '../tutorials/' WHEN 'how-to' THEN '../how_to/' ELSE '../' || b || '/' END AS base, f.n AS rows, n.n - coalesce(m.n, 0) AS targets
FROM m f JOIN r ON f.category = a JOIN n ON n.category = b LEFT JOIN m ON m.title = f.title AND m.category = b WHERE n.n - coalesce(m.n, 0) > 0""")
def crossref_links(spark, sf):
    """Links of all documents as groups: each to all documents of a category but those of its own title."""
    d = read(spark, sf, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), CATEGORY(F.col("doc_id")).alias("category"))
    return crossref.link_groups(d)


@query(f"""SELECT array_position(['tutorial', 'how-to', 'reference', 'explanation'], category) AS place, category, title FROM (SELECT doc_id AS title, {CATEGORY_SQL.format('doc_id')} AS category FROM documents)""")
def main_index(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("title"), CATEGORY(F.col("doc_id")).alias("category"))
    return crossref.index_rows(d).withColumn("place", F.col("place").cast("int"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<h[1-6][ >]')) AS headings, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages")
def html_headings(spark, sf):
    h = F.col("html")
    n = lambda rx: F.size(F.regexp_extract_all(h, F.lit(rx), F.lit(0))).cast("long")
    return read(spark, sf, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), n("<h[1-6][ >]").alias("headings"), n("<a [^>]*href=").alias("links"))


# -- monitoring --------------------------------------------------------------


def operations(spark, sf):
    e = read(spark, sf, "events")
    return e.select((F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 4 != 0).alias("cached"), (F.col("event_type") == "signup").alias("fallback"), F.col("value").alias("ms"), "ts", "event_id", F.col("event_type").alias("name"))


@query("""SELECT count(*) AS operations, sum((event_type <> 'error')::INT)::BIGINT AS succeeded, sum((user_id % 4 <> 0)::INT)::BIGINT AS hits, sum((event_type = 'signup')::INT)::BIGINT AS fallbacks,
 round(avg(value), 6) AS avg_ms, round(avg((user_id % 4 <> 0)::INT), 6) AS hit_rate, round(avg((event_type = 'signup')::INT), 6) AS fallback_rate, round(avg((event_type = 'error')::INT), 6) AS error_rate FROM events""")
def extraction_metrics(spark, sf):
    return rounded(monitoring.extraction(operations(spark, sf)))


@query("""WITH l AS (SELECT list_sort(list(value)) AS v FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000))
SELECT v[round(0.5 * (len(v) - 1))::INT + 1] AS p50, v[round(0.95 * (len(v) - 1))::INT + 1] AS p95, v[round(0.99 * (len(v) - 1))::INT + 1] AS p99 FROM l""")
def latency_percentiles(spark, sf):
    return monitoring.last_percentiles(operations(spark, sf), ["ts", "event_id"])


@query("""SELECT event_type AS name, count(*) AS count, round(sum(value), 6) AS total, min(value) AS min, max(value) AS max, last(value ORDER BY ts, event_id) AS last, round(avg(value), 6) AS avg, quantile_disc(value, 0.95) AS p95,
 round(avg(value) + 0.7 * (max(value) - avg(value)), 6) AS p95_estimate, round(avg(value) + 0.9 * (max(value) - avg(value)), 6) AS p99_estimate FROM events GROUP BY 1""")
def timing_report(spark, sf):
    return rounded(monitoring.timings(operations(spark, sf), order=("ts", "event_id")))


@query("""WITH s AS (SELECT avg((event_type = 'error')::INT) AS e, avg(value) AS t, avg((user_id % 4 <> 0)::INT) AS h, count(*) AS n FROM events)
SELECT 'error_rate' AS alert, CASE WHEN e >= 0.1 THEN 'critical' ELSE 'warning' END AS severity, round(e, 6) AS value FROM s WHERE e >= 0.05
UNION ALL SELECT 'time', 'warning', round(t, 6) FROM s WHERE t >= 5000 UNION ALL SELECT 'hit_rate', 'warning', round(h, 6) FROM s WHERE h < 0.8 AND n > 100""")
def alert_rules(spark, sf):
    return rounded(monitoring.alerts(monitoring.extraction(operations(spark, sf))))


@query("""SELECT (user_id % 3)::VARCHAR AS variant, count(*) AS runs, round(avg((event_type <> 'error')::INT), 6) AS success_rate, round(avg(value), 6) AS avg_ms,
 round(coalesce(sum(event_id % 7) FILTER (event_type <> 'error') / nullif(count(*) FILTER (event_type <> 'error'), 0)::DOUBLE, 0), 6) AS keywords_per_success FROM events GROUP BY 1""")
def prompt_variants(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 3).cast("string").alias("variant"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"), (F.col("event_id") % 7).alias("keywords"))
    return rounded(monitoring.variants(e))


@query("""WITH s AS (SELECT count(*) FILTER (a = 'control') AS control_n, avg(value) FILTER (a = 'control') AS control_mean, var_samp(value) FILTER (a = 'control') AS control_var,
 count(*) FILTER (a = 'treatment') AS treatment_n, avg(value) FILTER (a = 'treatment') AS treatment_mean, var_samp(value) FILTER (a = 'treatment') AS treatment_var
FROM (SELECT value, CASE WHEN user_id % 100 < 30 THEN 'treatment' ELSE 'control' END AS a FROM events))
SELECT control_n, round(control_mean, 6) AS control_mean, round(control_var, 6) AS control_var, treatment_n, round(treatment_mean, 6) AS treatment_mean, round(treatment_var, 6) AS treatment_var,
 round(treatment_mean - control_mean, 6) AS difference, round((treatment_mean - control_mean) / sqrt(control_var / control_n + treatment_var / treatment_n), 6) AS t FROM s""")
def ab_comparison(spark, sf):
    e = read(spark, sf, "events").select("value", F.when(F.col("user_id") % 100 < 30, "treatment").otherwise("control").alias("arm"))
    return rounded(monitoring.comparison(e, "arm", "value"))


@query("""SELECT doc_id, lang, CASE WHEN ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT % 100 < 30 THEN 'treatment' ELSE 'control' END AS arm FROM documents""")
def ab_assignment(spark, sf):
    return keywords.arms(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 30)


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN (CASE WHEN doc_id % 20 = 0 THEN 'treatment' ELSE 'control' END) WHEN ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT % 100 < 30 THEN 'treatment' ELSE 'control' END AS arm FROM documents""")
def ab_stored_arms(spark, sf):
    """Arms where every tenth document has a stored one, which stays."""
    d = read(spark, sf, "documents").select("doc_id")
    stored = d.where("doc_id % 10 = 0").withColumn("arm", F.when(F.col("doc_id") % 20 == 0, "treatment").otherwise("control"))
    return keywords.arms(d, "doc_id", 30, stored)


@query("""SELECT line FROM (SELECT unnest(list_concat(list_transform([10, 50, 100, 250], lambda b: 'ms_bucket{le="' || b || '"} ' || len(list_filter(v, lambda x: x <= b))),
 ['ms_bucket{le="+Inf"} ' || len(v), 'ms_sum ' || printf('%.6f', s), 'ms_count ' || len(v)])) AS line FROM (SELECT list(value) AS v, sum(value) AS s FROM events))""")
def exposition(spark, sf):
    return monitoring.histogram(read(spark, sf, "events"), "value", [10, 50, 100, 250], "ms")


@query("""SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey""")
def job_queue(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("completed").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("queued_at"))
    return monitoring.queue(o).select("job_id")


# -- changes and code --------------------------------------------------------

PATHS = ["crates/api/src/lib.rs", "docs/README.md", "config/app.yaml", "src/main.py", "tests/a_test.go", "Cargo.toml"]


def change_sets(spark, sf):
    o = read(spark, sf, "orders")
    paths = F.transform(F.sequence(F.lit(0), (F.col("o_custkey") % 4).cast("int")), lambda k: F.element_at(F.array(*map(F.lit, PATHS)), (F.pmod(F.col("o_orderkey") + k, F.lit(6)) + 1).cast("int")))
    files = F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit("modified").alias("change"), F.lit(10).alias("lines")))
    note = F.when(F.col("o_orderkey") % 17 == 0, "BREAKING: new api").otherwise("fix")
    return o.select("o_orderkey", files.alias("files"), F.array(note).alias("commits"), (F.col("o_totalprice") / 500).cast("long").alias("total"))


@query("""WITH s AS (SELECT o_orderkey, list_transform(range(0, (o_custkey % 4) + 1), lambda k: (['crates/api/src/lib.rs', 'docs/README.md', 'config/app.yaml', 'src/main.py', 'tests/a_test.go', 'Cargo.toml'])[((o_orderkey + k) % 6) + 1]) AS f,
  o_orderkey % 17 = 0 AS b, trunc(o_totalprice / 500)::BIGINT AS total FROM orders),
p AS (SELECT *, 2 * len(list_filter(f, lambda x: x = 'Cargo.toml' OR x LIKE '%/lib.rs')) + CASE WHEN total > 500 THEN 2 ELSE 0 END + CASE WHEN b THEN 5 ELSE 0 END AS score FROM s)
SELECT o_orderkey, score::INTEGER AS score, CASE WHEN score >= 7 THEN 'critical' WHEN score >= 4 THEN 'major' WHEN score >= 2 THEN 'minor' ELSE 'trivial' END AS level,
 CASE WHEN b THEN 'critical' WHEN len(list_filter(f, lambda x: contains(x, '/api/'))) > 0 THEN 'high' WHEN len(list_filter(f, lambda x: contains(x, 'README') OR contains(x, 'docs/'))) > 0 THEN 'medium' ELSE 'low' END AS priority FROM p""")
def change_significance(spark, sf):
    c = change_sets(spark, sf)
    points = changes.score(F.col("files"), F.col("commits"), F.col("total"), ["Cargo.toml", "*/lib.rs"])
    return c.select("o_orderkey", points.cast("int").alias("score"), changes.significance(points).alias("level"), changes.update_priority(F.col("files"), F.col("commits")).alias("priority"))


@query("""SELECT language, weight FROM (SELECT CASE x WHEN 'rs' THEN 'rust' WHEN 'md' THEN 'markdown' WHEN 'yaml' THEN 'yaml' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' ELSE 'toml' END AS language,
 count(*)::BIGINT AS weight FROM (SELECT (['rs', 'md', 'yaml', 'py', 'go', 'toml'])[(o_orderkey % 6) + 1] AS x FROM orders) GROUP BY 1
 UNION ALL SELECT 'rust', 10 * count(*) FROM orders WHERE o_orderkey % 6 = 5) WHERE language <> 'rust'
UNION ALL SELECT 'rust', (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 0) + 10 * (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 5)""")
def language_census(spark, sf):
    files = read(spark, sf, "orders").select(F.element_at(F.array(*map(F.lit, PATHS)), (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int")).alias("path"))
    return code.language_census(files).select("language", F.col("weight").cast("long").alias("weight"))


#: Of every language with an analyzer: extension, comment mark, and what follows the comment.
SOURCES = [
    ("rs", "/// ", "pub fn NAME(a: Vec<(u8, u8)>, b: &str) -> Option<u8> {\n}\n\nstruct S {\n    x: u8,\n}\n"),
    ("go", "// ", "func NAME(a int, b string) error {\n}\n\ntype S struct {\n\tx int\n}\n"),
    ("py", "# ", "def NAME(a, b=(1, 2)) -> int:\n    \"\"\"A note\"\"\"\n\nclass S:\n    pass\n"),
    ("js", "// ", "export function NAME(a, b) {\n}\n\nclass S {\n}\n"),
    ("ts", "// ", "export function NAME(a: number, b: string) {\n}\n\ninterface S {\n    x: number;\n}\n"),
    ("java", "// ", "public class S {\n    public static int NAME(int a, List<Integer> b) {\n    }\n}\n"),
]


def source_files(d: DataFrame) -> DataFrame:
    """(path, text): every document as the comment of a source file, the languages in turn."""
    name = F.concat(F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in SOURCES]), (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(SOURCES))) + 1).cast("int"))
    note = F.concat(pick(1), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.concat(F.lit("\n"), pick(1))), F.lit("\n"))
    path = F.concat(F.concat_ws("/", "source", name), F.lit("."), pick(0))
    return d.select(path.alias("path"), F.concat(note, F.replace(pick(2), F.lit("NAME"), name)).alias("text"))


#: What stands in the files by language: item, its line after the comment, and the words that its parts are made of.
ITEMS_SQL = """(VALUES
  (0, 'rs', 'function', 'NAME', 'public', ['a: Vec<(u8, u8)>', 'b: &str'], 'Option<u8>', true, NULL, [], 1), (0, 'rs', 'struct', 'S', 'private', [], NULL, false, NULL, ['x: u8'], 4),
  (1, 'go', 'function', 'NAME', 'private', ['a int', 'b string'], 'error', true, NULL, [], 1), (1, 'go', 'struct', 'S', 'public', [], NULL, false, NULL, ['x int'], 4),
  (2, 'py', 'function', 'NAME', 'public', ['a', 'b=(1, 2)'], 'int', false, 'A note', [], 1), (2, 'py', 'class', 'S', 'public', [], NULL, false, NULL, [], 4),
  (3, 'js', 'function', 'NAME', 'public', ['a', 'b'], NULL, false, NULL, [], 1), (3, 'js', 'class', 'S', 'public', [], NULL, false, NULL, [], 4),
  (4, 'ts', 'function', 'NAME', 'public', ['a: number', 'b: string'], NULL, false, NULL, [], 1), (4, 'ts', 'interface', 'S', 'public', [], NULL, false, NULL, ['x: number'], 4),
  (5, 'java', 'class', 'S', 'public', [], NULL, false, NULL, [], 1), (5, 'java', 'function', 'NAME', 'public', ['int a', 'List<Integer> b'], 'int', false, NULL, [], 2)
) i(k, extension, kind, name, visibility, params, returns, commented, note, fields, at_line)"""


@query(f"""WITH d AS (SELECT doc_id, source || '/f' || doc_id AS path, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
SELECT path || '.' || extension AS path, kind, replace(name, 'NAME', 'f' || doc_id) AS name, visibility, array_to_string(params, '; ') AS params, returns,
  md5(CASE WHEN commented THEN nullif(regexp_replace(array_to_string(list_transform(lines, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10)), '^\\s+|\\s+$', '', 'g'), '') ELSE note END) AS documentation,
  array_to_string(fields, '; ') AS fields, (len(lines) + at_line)::INTEGER AS line FROM d JOIN {ITEMS_SQL} ON doc_id % 6 = k""")
def code_structure(spark, sf):
    """Items of source files made from the document table, each text as the comment of a file of one of six languages."""
    made = code.structure(source_files(read(spark, sf, "documents")))
    listed = lambda c: F.array_join(c, "; ").alias(c)
    note = F.md5(tx.stripped(F.col("documentation")).cast("binary")).alias("documentation")
    return made.select("path", "kind", "name", "visibility", listed("params"), "returns", note, listed("fields"), "line")
