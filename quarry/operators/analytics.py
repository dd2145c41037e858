"""Search-usage and result-quality metrics over an event table.

Events: type (``query``, ``click`` or ``session_end``), query_id, session_id,
user_id, query, query_type, result_count, execution_time_ms, zero_results,
position (from 0), time_to_click_ms, duration_ms, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PERIODS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 24 HOURS", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 30 DAYS"}


def is_query() -> Column:
    return F.col("type") == "query"


def is_click() -> Column:
    return F.col("type") == "click"


def is_end() -> Column:
    return F.col("type") == "session_end"


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def within(events: DataFrame, period: str, now: Column, start: Column | None = None) -> DataFrame:
    """Events of the last hour, day, week or month before ``now``, or since ``start`` (``custom``); both ends count."""
    begin = now - F.expr(PERIODS[period]) if period in PERIODS else start if start is not None else now - F.expr(PERIODS["month"])
    return events.where(F.col("ts").between(begin, now))


def usage_columns(distinct=F.countDistinct) -> list[Column]:
    """Aggregates over query events; distinct: streams take an approximate count."""
    return [
        F.count("*").alias("total_queries"), distinct("session_id").alias("unique_sessions"), distinct("user_id").alias("unique_users"),
        F.coalesce(F.sum(F.col("zero_results").cast("long")), F.lit(0)).alias("zero_result_queries"),
        or_zero(F.avg("result_count")).alias("avg_results"), or_zero(F.avg("execution_time_ms")).alias("avg_execution_ms"),
    ]


def usage(events: DataFrame, *by: str) -> DataFrame:
    """Counts and means of queries, of all or by columns; 0 where there are none."""
    return events.where(is_query()).groupBy(*by).agg(*usage_columns())


def usage_rollup(events: DataFrame, *by: str) -> DataFrame:
    return events.where(is_query()).rollup(*by).agg(*usage_columns())


def popular(events: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent query texts with their click-through: queries with a click over queries; ties by text."""
    queries = events.where(is_query())
    clicked = events.where(is_click()).select(F.col("query_id").alias("c_id")).distinct()
    joined = queries.join(clicked, queries["query_id"] == F.col("c_id"), "left")
    each = joined.groupBy("query").agg(F.count("*").alias("count"), or_zero(F.avg("result_count")).alias("avg_results"), F.avg(F.col("c_id").isNotNull().cast("double")).alias("click_through_rate"))
    return each.orderBy(F.desc("count"), "query").limit(n)


def by_type(events: DataFrame) -> DataFrame:
    return events.where(is_query()).groupBy("query_type").agg(F.count("*").alias("count"))


def without_results(events: DataFrame, n: int = 20) -> DataFrame:
    """First texts that found nothing, in the order they came."""
    return events.where(is_query() & F.col("zero_results")).orderBy("ts", "query_id").select("query", "ts", "query_id").limit(n)


def relevance(ctr: Column, position: Column, clicked: Column) -> Column:
    """Score of 0 to 1 from click-through, mean position and the share of queries with clicks."""
    place = F.when(position <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(position / 10.0, F.lit(1.0))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * ctr + 0.3 * place + 0.3 * clicked))


def quality(events: DataFrame, *by: str) -> DataFrame:
    """Click-through, positions, times and sessions, with the relevance score; one pass."""
    count = lambda c: F.sum(c.cast("long"))
    made = events.groupBy(*by).agg(
        F.coalesce(count(is_query()), F.lit(0)).alias("queries"), F.coalesce(count(is_click()), F.lit(0)).alias("clicks"),
        or_zero(F.avg(F.when(is_click(), F.col("position")))).alias("avg_click_position"), or_zero(F.avg(F.when(is_click(), F.col("time_to_click_ms")))).alias("avg_time_to_click_ms"),
        F.countDistinct(F.when(is_click(), F.col("query_id"))).alias("clicked"), F.countDistinct(F.when(is_query(), F.col("session_id"))).alias("sessions"),
        or_zero(F.avg(F.when(is_end(), F.col("duration_ms")))).alias("avg_session_ms"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    made = made.withColumn("click_through_rate", share("clicks", "queries")).withColumn("queries_with_clicks", share("clicked", "queries")).withColumn("queries_per_session", share("queries", "sessions"))
    return made.withColumn("relevance", relevance(F.col("click_through_rate"), F.col("avg_click_position"), F.col("queries_with_clicks"))).drop("clicked", "sessions")
