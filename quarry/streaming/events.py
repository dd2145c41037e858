"""The streaming edition: windowed usage metrics, change state, cooldowns, subscriptions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators import reverse
from quarry.operators.analytics import is_query, usage_columns
from quarry.operators.ordered import spaced


def windowed_usage(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Usage metrics by window of event time; events later than the watermark are left out.

    Distinct counts are sketches, as streams can't keep exact ones in bounded state.
    """
    asked = events.where(is_query()).withWatermark("ts", late)
    made = asked.groupBy(F.window("ts", size, slide)).agg(*usage_columns(F.approx_count_distinct))
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in made.columns if c != "window"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by user: runs of events with no gap as long as ``gap``."""
    made = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return made.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def collected(events: DataFrame, path: str, checkpoint: str, every: str = "60 seconds"):
    """Writes an event stream to Parquet once per interval, each event once; returns the running query."""
    dated = events.withColumn("day", F.to_date("ts"))
    return dated.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def changed(commits: DataFrame) -> DataFrame:
    """A row whenever a repository's head is another than before; its first sight is a ``baseline``.

    commits: repository, commit, ts.
    """

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        (last,) = state.get if state.exists else (None,)
        out = []
        for commit, ts in zip(rows["commit"], rows["ts"]):
            if commit != last:
                out.append((key[0], "baseline" if last is None else "change", last, commit, ts))
                last = commit
        state.update((last,))
        yield pd.DataFrame(out, columns=["repository", "kind", "before", "after", "ts"])

    return commits.groupBy("repository").applyInPandasWithState(step, "repository string, kind string, before string, after string, ts timestamp", "commit string", "append", GroupStateTimeout.NoTimeout)


COMMANDS = ("tick", "check", "pause", "resume", "stop")


def polls(signals: DataFrame) -> DataFrame:
    """(repository, ts, by) whenever a repository is to be looked at: at its ticks while it isn't paused, at a ``check`` also then, never after a ``stop``.

    signals: repository, command (of COMMANDS; others are an error), ts. Of equal
    times the order of COMMANDS counts.
    """

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(frames))
        unknown = set(rows["command"]) - set(COMMANDS)
        if unknown:
            raise ValueError(f"unknown commands: {sorted(map(str, unknown))}")
        rows = rows.assign(place=rows["command"].map(COMMANDS.index)).sort_values(["ts", "place"], kind="stable")
        (mode,) = state.get if state.exists else ("on",)
        out = []
        for command, ts in zip(rows["command"], rows["ts"]):
            if mode == "stopped":
                break
            if command == "check" or command == "tick" and mode == "on":
                out.append((key[0], ts, command))
            mode = {"pause": "paused", "resume": "on", "stop": "stopped"}.get(command, mode)
        state.update((mode,))
        yield pd.DataFrame(out, columns=["repository", "ts", "by"])

    return signals.groupBy("repository").applyInPandasWithState(step, "repository string, ts timestamp, by string", "mode string", "append", GroupStateTimeout.NoTimeout)


def cooled(triggers: DataFrame, key: str = "repository", seconds: int = 600) -> DataFrame:
    """Triggers that come ``seconds`` or more after the last one let through for their key."""

    def step(k, frames: Iterator, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        last = state.get[0] if state.exists else None
        out = []
        for ts in rows["ts"]:
            at = ts.timestamp()
            if last is None or at - last >= seconds:
                out.append((k[0], ts))
                last = at
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ts"])

    return triggers.groupBy(key).applyInPandasWithState(step, f"{key} string, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def cooled_batch(triggers: DataFrame, key: str = "repository", seconds: int = 600, ts: str = "ts", parts: int | None = None) -> DataFrame:
    """:func:`cooled` over a table: whole rows of the triggers let through, however many a key has.

    Each accepted trigger is followed by the first one ``seconds`` or more after
    it, which depends on all before; ranges of a key compose (see ``spaced``).
    """
    timed = triggers.where(F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    return spaced(timed, [key], "_at", seconds * 1_000_000, parts).drop("_at")


LISTS = {"categories": "category", "repositories": "repository", "document_ids": "document_id", "tags": "tags"}


def delivered(updates: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Updates for every subscription they fit: (conn_id, sub_id, update...).

    A list that is absent fits all; one that is present must hold the update's
    value, tags any of its tags. updates: document_id, category, repository, tags.
    Subscriptions are indexed by their shortest list, so that an update meets those
    that ask for one of its values, and those that ask for nothing.
    """
    index = reverse.indexed(reverse.of_subscriptions(subscriptions.select("conn_id", "sub_id", *LISTS), LISTS))
    return reverse.matched(updates, index, reverse.held(["category", "repository", "document_id"], ["tags"]), ["conn_id", "sub_id"])
