"""Queries over series and kept aggregates: spacing, sliding percentiles, deliveries, usage that is read once, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import changes, quality, text as tx
from quarry.operators import analytics, code, monitoring, search
from quarry.operators.ordered import numbered
from quarry.operators.rollups import UsageRollups
from quarry.plans.queries import EV, query, r6, read, search_events
from quarry.session import scratch
from quarry.streaming import events

# -- series ------------------------------------------------------------------


@query("""WITH RECURSIVE t AS MATERIALIZED (SELECT user_id % 7 AS repository, epoch_us(ts) AS moment FROM events WHERE event_type <> 'view' GROUP BY ALL),
g AS (SELECT repository, min(moment) AS moment FROM t GROUP BY 1 UNION ALL SELECT g.repository, min(t.moment) FROM g JOIN t ON t.repository = g.repository AND t.moment >= g.moment + 21600000000 GROUP BY g.repository, g.moment)
SELECT repository, moment FROM g""")
def cooldown_triggers(spark, sf):
    """Triggers let through when each one silences its key for six hours; seven keys over all ranges."""
    e = read(spark, sf, "events").where("event_type <> 'view'").select((F.col("user_id") % 7).alias("repository"), "ts")
    return events.cooled_batch(e, seconds=6 * 3600, parts=8).select("repository", F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"))


@query("""WITH w AS (SELECT event_id, event_type, list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS v FROM events)
SELECT event_id, event_type, list_sort(v)[round(0.5 * (len(v) - 1))::INTEGER + 1] AS p50, list_sort(v)[round(0.95 * (len(v) - 1))::INTEGER + 1] AS p95, list_sort(v)[round(0.99 * (len(v) - 1))::INTEGER + 1] AS p99 FROM w""")
def sliding_latency(spark, sf):
    """Percentiles of the last hundred values of a type, at every event."""
    e = read(spark, sf, "events").select("event_id", "event_type", "ts", F.col("value").alias("ms"))
    return monitoring.sliding_percentiles(e, "event_type", ["ts", "event_id"], window=100).select("event_id", "event_type", "p50", "p95", "p99")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 25)::INTEGER AS batch, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 25 < (SELECT (count(*) - 1) // 25 FROM documents) AS has_more FROM documents")
def deliveries(spark, sf):
    """All documents in deliveries of 25, longest first."""
    d = read(spark, sf, "documents").select("doc_id", "n_chars")
    return search.batches(d, 25, F.desc("n_chars"), F.asc("doc_id")).drop("n_chars")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place FROM documents")
def places_by_source(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return numbered(d, [F.asc("n_chars"), F.asc("doc_id")], ["source"], "place").select("doc_id", "place")


@query("""WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS, true) AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, epoch_us(min(ts)) AS first, count(*) AS events FROM s GROUP BY user_id, n""")
def event_sessions(spark, sf):
    """Runs of a user's events with no gap of six hours."""
    made = events.sessions(read(spark, sf, "events").select("ts", "user_id"), "6 hours")
    return made.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("first"), "events")


# -- kept aggregates ---------------------------------------------------------


def kept_events(spark, sf, compacted: bool = False) -> UsageRollups:
    """Search events taken in as three increments, one of them twice, with late ones in each."""
    kept, e = UsageRollups(spark, scratch(spark)), search_events(spark, sf)
    for k in (0, 1, 2):
        kept.put(e.where(F.pmod("event_id", F.lit(9)).between(3 * k, 3 * k + 2)), k)
    kept.put(e.where(F.pmod("event_id", F.lit(9)) > 5), 2)  # a replay
    if compacted:
        kept.compact()
    return kept


@query(EV + """ SELECT count(*) AS total_queries, true AS sessions_close, true AS users_close, count(*) FILTER (zero_results) AS zero_result_queries, round(avg(result_count), 6) AS avg_results, round(avg(execution_time_ms), 6) AS avg_execution_ms, true AS p50_close, true AS p95_close FROM ev WHERE type = 'query'""")
def kept_usage(spark, sf):
    """Usage from kept aggregates; distinct counts and percentiles against the events, within their stated errors."""
    e = search_events(spark, sf).where("type = 'query'")
    true_ = e.agg(F.count_distinct("session_id").alias("s"), F.count_distinct("user_id").alias("u"))
    made = kept_events(spark, sf).usage()
    rank = lambda p: e.crossJoin(F.broadcast(made.select(f"p{p}_ms"))).agg(F.avg((F.col("execution_time_ms") < F.col(f"p{p}_ms")).cast("double")).alias(f"b{p}"), F.avg((F.col("execution_time_ms") <= F.col(f"p{p}_ms")).cast("double")).alias(f"a{p}"))  # noqa: E731  one row beside the events
    row = made.crossJoin(true_).crossJoin(rank(50)).crossJoin(rank(95))  # one row each
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), 0.06 * F.col(b))
    within = lambda p: (F.col(f"b{p}") - 0.02 <= p / 100) & (F.col(f"a{p}") + 0.02 >= p / 100)
    return row.select(
        "total_queries", close("unique_sessions", "s").alias("sessions_close"), close("unique_users", "u").alias("users_close"), "zero_result_queries", r6(F.col("avg_results")).alias("avg_results"),
        r6(F.col("avg_execution_ms")).alias("avg_execution_ms"), within(50).alias("p50_close"), within(95).alias("p95_close"),
    )


@query(EV + " SELECT date_trunc('hour', ts) AS hour, count(*) AS total_queries, count(*) FILTER (zero_results) AS zero_result_queries FROM ev WHERE type = 'query' AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00' GROUP BY 1")
def kept_hours(spark, sf):
    """A week by hour, after a compaction."""
    start, end = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").cast("timestamp"), F.lit("2024-01-08 23:00:00").cast("timestamp_ntz").cast("timestamp")
    made = kept_events(spark, sf, compacted=True).usage(start, end, "hour").where("total_queries > 0")
    return made.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "total_queries", "zero_result_queries")


@query(EV + """, p AS (SELECT query, count(*) AS count, round(avg(result_count), 6) AS avg_results FROM ev WHERE type = 'query' GROUP BY 1 ORDER BY count DESC, query LIMIT 10) SELECT * FROM p""")
def kept_popular(spark, sf):
    return kept_events(spark, sf).popular(10).withColumn("avg_results", r6(F.col("avg_results")))


@query(EV + """ SELECT count(*) FILTER (type = 'query') AS queries, count(*) FILTER (type = 'click') AS clicks, round(avg(position) FILTER (type = 'click'), 6) AS avg_click_position, round(avg(time_to_click_ms) FILTER (type = 'click'), 6) AS avg_time_to_click_ms, round(avg(duration_ms) FILTER (type = 'session_end'), 6) AS avg_session_ms FROM ev""")
def kept_quality(spark, sf):
    made = kept_events(spark, sf, compacted=True).quality()
    return made.select("queries", "clicks", *[r6(F.col(c)).alias(c) for c in ("avg_click_position", "avg_time_to_click_ms", "avg_session_ms")])


# -- reports -----------------------------------------------------------------

OPERATIONS = """o AS (SELECT event_id, ts, event_type <> 'error' AS ok, user_id % 3 = 0 AS cached, user_id % 10 = 0 AS fallback, value * 20 AS ms, event_type AS variant FROM events)"""


def operations(spark, sf):
    e, u = read(spark, sf, "events"), F.col("user_id")
    return e.select("event_id", "ts", (F.col("event_type") != "error").alias("ok"), (u % 3 == 0).alias("cached"), (u % 10 == 0).alias("fallback"), (F.col("value") * 20).alias("ms"), F.col("event_type").alias("variant"))


SNAPSHOT = f"""{OPERATIONS}, l AS (SELECT list_sort(list(ms)) AS v FROM (SELECT ms FROM o ORDER BY ts DESC, event_id DESC LIMIT 1000)),
s AS (SELECT count(*) AS operations, count(*) FILTER (ok) AS succeeded, count(*) FILTER (cached) AS hits, count(*) FILTER (fallback) AS fallbacks, avg(ms) AS avg_ms, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM o)"""


@query(f"""WITH {SNAPSHOT} SELECT operations, succeeded, hits, fallbacks, round(avg_ms, 6) AS avg_ms, round(hits / operations, 6) AS hit_rate, round(fallbacks / operations, 6) AS fallback_rate, round((operations - succeeded) / operations, 6) AS error_rate,
 round(v[round(0.5 * (len(v) - 1))::INTEGER + 1], 6) AS p50, round(v[round(0.95 * (len(v) - 1))::INTEGER + 1], 6) AS p95, round(v[round(0.99 * (len(v) - 1))::INTEGER + 1], 6) AS p99, round(span / 1000000.0, 3)::DOUBLE AS uptime_s FROM s, l""")
def metrics_snapshot(spark, sf):
    made = monitoring.snapshot(operations(spark, sf), ["ts", "event_id"])
    counts = ["operations", "succeeded", "hits", "fallbacks"]
    return made.select(*counts, *[r6(F.col(c)).alias(c) for c in made.columns if c not in (*counts, "uptime_s")], F.round("uptime_s", 3).alias("uptime_s"))


@query(f"WITH {OPERATIONS}, s AS (SELECT count(*) AS operations, count(*) FILTER (ok) AS succeeded, count(*) FILTER (cached) AS hits FROM o) SELECT unnest(['quarry_operations ' || operations, 'quarry_succeeded ' || succeeded, 'quarry_hits ' || hits]) AS line FROM s")
def metric_lines(spark, sf):
    """A snapshot's counts as lines of the text format."""
    return monitoring.gauges(monitoring.extraction(operations(spark, sf)).select("operations", "succeeded", "hits"), "quarry")


@query("""WITH c AS (SELECT CASE WHEN n_chars < 50 THEN 'skipped' WHEN doc_id % 17 = 0 THEN 'error' ELSE 'enriched' END AS status, doc_id % 5 AS k FROM documents)
SELECT count(*) FILTER (status = 'enriched') AS enriched, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error, round(avg(k) FILTER (status = 'enriched'), 6) AS keywords_per_chunk,
 round(count(*) FILTER (status = 'error') / count(*) FILTER (status <> 'skipped'), 6) AS error_rate FROM c""")
def enrichment_stats(spark, sf):
    d = read(spark, sf, "documents")
    status = F.when(F.col("n_chars") < 50, "skipped").when(F.col("doc_id") % 17 == 0, "error").otherwise("enriched")
    made = monitoring.enrichment(d.select(status.alias("status"), F.slice(F.array(*map(F.lit, "abcd")), 1, (F.col("doc_id") % 5).cast("int")).alias("keywords")))
    return made.withColumn("keywords_per_chunk", r6(F.col("keywords_per_chunk"))).withColumn("error_rate", r6(F.col("error_rate")))


JOBS = """j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_hours(o_orderkey % 48 + 1) END AS completed_at FROM orders)"""


def job_table(spark, sf):
    o = read(spark, sf, "orders")
    s, at = F.col("o_orderstatus"), F.col("o_orderdate")
    status = F.when(s == "F", "completed").when(s == "P", "failed").otherwise("queued")
    done = F.when(s != "O", at + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 48 + 1).cast("int")))
    return o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), at.alias("started_at"), done.alias("completed_at"))


@query(f"""WITH {JOBS}, t AS (SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS s FROM j)
SELECT count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, round(count(*) FILTER (status = 'completed') / count(*) FILTER (status <> 'queued'), 6) AS success_rate, round(avg(s), 6) AS avg_s, round(count(*) FILTER (status <> 'queued') / (sum(s) / 3600), 6) AS per_hour FROM t""")
def job_stats(spark, sf):
    made = monitoring.jobs(job_table(spark, sf))
    return made.select("jobs", "completed", *[r6(F.col(c)).alias(c) for c in ("success_rate", "avg_s", "per_hour")])


@query(f"WITH {JOBS} SELECT job_id, status FROM j WHERE completed_at IS NOT NULL ORDER BY completed_at DESC, job_id LIMIT 100")
def recent_jobs(spark, sf):
    return monitoring.recent(job_table(spark, sf)).select("job_id", "status")


@query(f"""WITH {OPERATIONS}, v AS (SELECT variant, avg((NOT ok)::INT) AS e, avg(cached::INT) AS h, avg(ms) AS ms, avg(fallback::INT) AS q FROM o GROUP BY 1)
SELECT variant, unnest(['error_rate', 'hit_rate', 'time', 'quality', 'improvement']) AS name, unnest([e <= 0.01, h >= 0.9, ms <= 2000, 1 - q >= 0.7, h - q >= 0.15]) AS passed FROM v""")
def readiness_checks(spark, sf):
    """Checks before a roll-out, by variant."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    v = operations(spark, sf).groupBy("variant").agg((1 - share("ok")).alias("e"), share("cached").alias("h"), F.avg("ms").alias("ms"), share("fallback").alias("q"))
    checks = quality.readiness(F.col("e"), F.col("h"), F.col("ms"), 1 - F.col("q"), F.col("h") - F.col("q"))
    return v.select("variant", F.explode(checks).alias("c")).select("variant", "c.*")


@query(f"""WITH {OPERATIONS} SELECT event_id, round(0.4 * f + 0.2 * r + 0.2 * p + 0.2 * (h + CASE WHEN t <= 1000 THEN 1.0 WHEN t <= 2000 THEN 0.8 WHEN t <= 5000 THEN 0.6 ELSE 0.3 END) / 2, 6)::DOUBLE AS score
FROM (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS f, (event_id % 7) / 6.0::DOUBLE AS r, (event_id % 5) / 4.0::DOUBLE AS p, (event_id % 3) / 2.0::DOUBLE AS h, ms * 3 AS t FROM o)""")
def extraction_scores(spark, sf):
    part = lambda n: (F.col("event_id") % n) / (n - 1.0)
    made = quality.extraction_quality(part(11), part(7), part(5), part(3), F.col("ms") * 3)
    return operations(spark, sf).select("event_id", r6(made).alias("score"))


@query("""SELECT doc_id, category, CASE WHEN category = 'tutorial' AND NOT (t LIKE '%step%' OR t LIKE '%example%') THEN 'warning' WHEN category = 'how-to' AND NOT (t LIKE '%how%' OR t LIKE '%to%') THEN 'info'
 WHEN category = 'reference' AND NOT (contains(text, '```') OR t LIKE '%api%') THEN 'warning' WHEN category = 'explanation' AND NOT (t LIKE '%why%' OR t LIKE '%because%') THEN 'info' END AS severity
FROM (SELECT doc_id, text, lower(text) AS t, (['tutorial', 'how-to', 'reference', 'explanation'])[doc_id % 4 + 1] AS category FROM documents)""")
def category_compliance(spark, sf):
    """Documents against the rule of their category."""
    d = read(spark, sf, "documents").withColumn("category", F.element_at(F.array(*map(F.lit, ["tutorial", "how-to", "reference", "explanation"])), (F.col("doc_id") % 4 + 1).cast("int")))
    return d.select("doc_id", "category", quality.compliance(F.col("category"), F.col("text")).alias("severity"))


@query("""SELECT doc_id, length(x) AS chars, md5(x) AS digest, CASE WHEN n < 1024 THEN 50 WHEN n < 10240 THEN 20 ELSE 5 END AS batch_size FROM (SELECT doc_id, strlen(text) AS n, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS x FROM documents)""")
def excerpts(spark, sf):
    """The beginning of every document, and how many of its size to ask for at once."""
    x = tx.excerpt(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.length(x).cast("long").alias("chars"), F.md5(x.cast("binary")).alias("digest"), changes.batch_size(F.octet_length("text")).alias("batch_size"))


PAGES = """f AS (SELECT page_id % 40 AS change, list({'path': path, 'lines': length(html) % 90} ORDER BY page_id) AS files, list(title ORDER BY page_id) AS commits, sum(length(html) % 90) AS total FROM (
  SELECT page_id, html, regexp_replace(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '[.]', '/', 'g') || (['.rs', '.md', '.yaml', '.proto', '/config'])[page_id % 5 + 1] AS path, lower(regexp_extract(html, '<title>([^<]*)', 1)) AS title FROM pages) GROUP BY 1)"""


@query(f"""WITH {PAGES} SELECT change, len(list_filter(files, lambda f: contains(f.path, 'api/') OR contains(f.path, 'interface') OR contains(f.path, 'contract') OR ends_with(f.path, '.proto'))) > 0 AS api,
 len(list_filter(files, lambda f: ends_with(f.path, '.yaml') OR ends_with(f.path, '.yml') OR ends_with(f.path, '.toml') OR ends_with(f.path, '.json') OR contains(f.path, 'config'))) > 0 AS config,
 list_filter([CASE WHEN total > 100 THEN 'review_api' END, CASE WHEN len(list_filter(commits, lambda m: contains(m, 'api'))) > 0 THEN 'update_api_reference' END, CASE WHEN len(list_filter(commits, lambda m: contains(m, 'config'))) > 0 THEN 'update_configuration' END], lambda x: x IS NOT NULL) AS suggestions,
 (total > 60) AND len(list_filter(files, lambda f: NOT ends_with(f.path, '.md') AND (ends_with(f.path, '.rs') OR ends_with(f.path, '.proto')))) > 0 AS update FROM f""")
def change_effects(spark, sf):
    """Changes made of pages: what they touch, and what should follow."""
    p = read(spark, sf, "pages")
    path = F.concat(F.regexp_replace(F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1), "[.]", "/"), F.element_at(F.array(*map(F.lit, [".rs", ".md", ".yaml", ".proto", "/config"])), (F.col("page_id") % 5 + 1).cast("int")))
    lines, title = F.length("html") % 90, F.lower(F.regexp_extract("html", "<title>([^<]*)", 1))
    f = p.groupBy((F.col("page_id") % 40).alias("change")).agg(
        F.array_sort(F.collect_list(F.struct("page_id", path.alias("path")))).alias("files"), F.collect_list(title).alias("commits"), F.sum(lines).alias("total"))
    files, commits, total = F.col("files"), F.col("commits"), F.col("total")
    update = changes.should_update(F.when(total > 60, 2).otherwise(1), files, ["**/*.proto"], ["**/*.md"])
    return f.select("change", changes.affects_api(files).alias("api"), changes.affects_config(files).alias("config"), changes.suggestions(commits, total).alias("suggestions"), update.alias("update"))


@query("""WITH v AS (SELECT source, CASE doc_id % 6 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'yaml' WHEN 4 THEN 'rust' END AS language FROM documents), n AS (SELECT source, language, count(*) AS n FROM v WHERE language IS NOT NULL GROUP BY ALL)
SELECT source, first(language ORDER BY n DESC, language) AS language, max(n) AS files FROM n GROUP BY 1""")
def primary_languages(spark, sf):
    """The language of most files of a source; marker files don't count more."""
    name = F.element_at(F.array(*map(F.lit, ["a.rs", "b.py", "c.go", "d.yaml", "Cargo.rs", "e.unknown"])), (F.col("doc_id") % 6 + 1).cast("int"))
    files = read(spark, sf, "documents").select("source", F.concat(F.lit("src/"), name).alias("path"))
    census = code.language_census(files, "source", weighted=False)
    return code.primary_language(census, "source").join(census, ["source", "language"]).select("source", "language", F.col("weight").cast("long").alias("files"))


@query("""SELECT o_orderkey AS job, epoch_us(o_orderdate) + 3600000000 * 100 // (o_orderkey % 99 + 1) AS done FROM orders WHERE (100 % (o_orderkey % 99 + 1)) = 0""")
def finish_estimates(spark, sf):
    """When a job ends that has done some percent in an hour."""
    at, percent = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 99 + 1
    o = read(spark, sf, "orders").where(100 % percent == 0)
    return o.select(F.col("o_orderkey").alias("job"), F.unix_micros(changes.finish_estimate(at, at + F.expr("INTERVAL 1 HOUR"), percent.cast("double"))).alias("done"))
