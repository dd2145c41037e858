"""Operational metrics: snapshots, percentiles, alerts, timing reports, text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.vector import nearest_rank
from quarry.operators.ordered import sliding


def seconds(at: Column) -> Column:
    return at.cast("timestamp").cast("double")


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def extraction(ops: DataFrame) -> DataFrame:
    """Snapshot of (ok, cached, fallback, ms) rows: counts, rates from 0 to 1, mean time."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    made = ops.agg(F.count("*").alias("operations"), n("ok").alias("succeeded"), n("cached").alias("hits"), n("fallback").alias("fallbacks"), F.coalesce(F.avg("ms"), F.lit(0.0)).alias("avg_ms"))
    total = F.col("operations")
    return made.withColumn("hit_rate", share(F.col("hits"), total)).withColumn("fallback_rate", share(F.col("fallbacks"), total)).withColumn("error_rate", share(total - F.col("succeeded"), total))


def snapshot(ops: DataFrame, order: list[str], window: int = 1000) -> DataFrame:
    """:func:`extraction` with the percentiles of the last ``window`` times and the seconds from the first row to the last."""
    span = ops.agg((seconds(F.max("ts")) - seconds(F.min("ts"))).alias("uptime_s"))
    return extraction(ops).join(last_percentiles(ops, order, "ms", window)).join(span)  # one row each


def collector(events: DataFrame, flushed: str = "flushed", failed: str = "failed") -> DataFrame:
    """One row over buffered events: waiting, total, flushed, errors."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    done, bad = F.col(flushed), F.col(failed)
    return events.agg(n(~done & ~bad).alias("buffer_size"), F.count("*").alias("total_events"), n(done).alias("total_flushed"), n(bad).alias("total_errors"))


def connections(table: DataFrame) -> DataFrame:
    """One row over (connection_id, subscription_id) rows: connections, subscriptions."""
    return table.agg(F.count_distinct("connection_id").alias("connections"), F.count("subscription_id").alias("subscriptions"))


def last_percentiles(ops: DataFrame, order: list[str], value: str = "ms", window: int = 1000) -> DataFrame:
    """p50, p95 and p99 (nearest rank) of the last ``window`` rows."""
    last = ops.orderBy(*[F.desc(c) for c in order]).limit(window)
    made = last.agg(F.collect_list(value).alias("v"))
    return made.select(*[nearest_rank(F.col("v"), p / 100).alias(f"p{p}") for p in (50, 95, 99)])


def sliding_percentiles(ops: DataFrame, by: str, order: list[str], value: str = "ms", window: int = 1000) -> DataFrame:
    """The same at every row of a series, over the rows up to it; a sorted list is carried along blocks of the series."""
    shares = {f"p{p}": p / 100 for p in (50, 95, 99)}
    return sliding(ops.select(by, *order, value), [F.col(c).asc() for c in order], value, shares, [by], window).select(by, *order, *shares)


def alerts(snapshot: DataFrame) -> DataFrame:
    """(alert, severity, value) rows of a snapshot's broken limits."""
    s = lambda name, severity, value: F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), value.cast("double").alias("value"))
    e, t, h = F.col("error_rate"), F.col("avg_ms"), F.col("hit_rate")
    rules = [F.when(e >= 0.10, s("error_rate", "critical", e)).when(e >= 0.05, s("error_rate", "warning", e)), F.when(t >= 5000, s("time", "warning", t)), F.when((h < 0.8) & (F.col("operations") > 100), s("hit_rate", "warning", h))]
    return snapshot.select(F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("a")).select("a.*")


def timings(spans: DataFrame, name: str = "name", ms: str = "ms", order: tuple[str, ...] = ("ts",), by_average: bool = False, above: float | None = None) -> DataFrame:
    """Report by scope: count, total, extremes, last, mean, true percentiles and quick estimates of them.

    The largest total comes first, or the largest mean; ``above``: scopes whose mean exceeds it.
    """
    made = spans.groupBy(name).agg(
        F.count("*").alias("count"), F.sum(ms).alias("total"), F.min(ms).alias("min"), F.max(ms).alias("max"), F.max_by(ms, F.struct(*order)).alias("last"), F.avg(ms).alias("avg"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {ms})").alias("p95"),
    )
    made = made if above is None else made.where(F.col("avg") > above)
    made = made.withColumn("p95_estimate", F.col("avg") + 0.7 * (F.col("max") - F.col("avg"))).withColumn("p99_estimate", F.col("avg") + 0.9 * (F.col("max") - F.col("avg")))
    return made.orderBy(F.desc("avg" if by_average else "total"), name)


def variants(runs: DataFrame) -> DataFrame:
    """By variant of (variant, ok, ms, keywords): success rate, mean time, keywords per success."""
    won = F.sum(F.col("ok").cast("long"))
    return runs.groupBy("variant").agg(F.count("*").alias("runs"), share(won, F.count("*")).alias("success_rate"), F.avg("ms").alias("avg_ms"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("keywords"))) / F.nullif(won, F.lit(0)), F.lit(0.0)).alias("keywords_per_success"))


def comparison(runs: DataFrame, arm: str, value: str) -> DataFrame:
    """Two arms side by side: sizes, means, difference and Welch's t."""
    s = runs.groupBy().pivot(arm, ["control", "treatment"]).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).na.fill(0, ["control_n", "treatment_n"])
    spread = F.sqrt(F.col("control_var") / F.nullif(F.col("control_n"), F.lit(0)) + F.col("treatment_var") / F.nullif(F.col("treatment_n"), F.lit(0)))
    lift = F.col("treatment_mean") - F.col("control_mean")
    return s.withColumn("difference", lift).withColumn("t", lift / F.nullif(spread, F.lit(0.0)))


def enrichment(rows: DataFrame) -> DataFrame:
    n = lambda v: F.coalesce(F.sum((F.col("status") == v).cast("long")), F.lit(0)).alias(v)
    made = rows.agg(n("enriched"), n("skipped"), n("error"), F.coalesce(F.avg(F.when(F.col("status") == "enriched", F.size("keywords"))), F.lit(0.0)).alias("keywords_per_chunk"))
    return made.withColumn("error_rate", share(F.col("error"), F.col("enriched") + F.col("error")))


def jobs(table: DataFrame) -> DataFrame:
    """Totals, success rate and throughput (finished jobs per hour of work) of (status, started_at, completed_at)."""
    took = seconds(F.col("completed_at")) - seconds(F.col("started_at"))
    done = F.sum((F.col("status") == "completed").cast("long"))
    over = F.sum(F.col("status").isin("completed", "failed").cast("long"))
    return table.agg(F.count("*").alias("jobs"), done.alias("completed"), share(done, over).alias("success_rate"), F.avg(took).alias("avg_s"), share(over.cast("double"), F.sum(took) / 3600).alias("per_hour"))


def queue(table: DataFrame) -> DataFrame:
    """Jobs to run: highest priority first, then the oldest."""
    return table.where("status = 'queued'").orderBy(F.desc("priority"), "queued_at", "job_id")


def recent(table: DataFrame, n: int = 100) -> DataFrame:
    return table.where("completed_at is not null").orderBy(F.desc("completed_at"), "job_id").limit(n)


def histogram(values: DataFrame, value: str, bounds: list[float], name: str) -> DataFrame:
    """Exposition lines of a cumulative histogram."""
    aggs = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{k}") for k, b in enumerate(bounds)]
    made = values.agg(*aggs, F.count(value).alias("n"), F.sum(value).alias("s"))
    lines = [F.format_string(f'{name}_bucket{{le="{b:g}"}} %d', f"b{k}") for k, b in enumerate(bounds)]
    lines += [F.format_string(f'{name}_bucket{{le="+Inf"}} %d', "n"), F.format_string(f"{name}_sum %.6f", F.coalesce(F.col("s").cast("double"), F.lit(0.0))), F.format_string(f"{name}_count %d", "n")]
    return made.select(F.explode(F.array(*lines)).alias("line"))


def gauges(snapshot: DataFrame, prefix: str) -> DataFrame:
    """Exposition lines of a one-row table's numbers."""
    return snapshot.select(F.explode(F.array(*[F.concat(F.lit(f"{prefix}_{c} "), F.col(c).cast("string")) for c in snapshot.columns])).alias("line"))
