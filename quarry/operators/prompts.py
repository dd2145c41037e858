"""Token budgets of prompts: what parts use, and which of them fit by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.text import token_estimate

#: Tokens that must be left for a part to be worth cutting.
WORTH = 100


def budgets(parts: DataFrame, by: str, name: str, text: str = "text", most: int = 4096, reserved: int = 512) -> DataFrame:
    """One row per prompt: total, available, used, remaining, within_limit, and the tokens of each part in the order of names."""
    each = parts.select(by, F.col(name).alias("name"), token_estimate(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    made = each.groupBy(by).agg(F.sum("tokens").alias("used"), F.array_sort(F.collect_list(F.struct("name", "tokens"))).alias("parts"))
    available = F.lit(most - reserved).cast("long")
    return made.select(by, F.lit(most).cast("long").alias("total"), available.alias("available"), "used", F.greatest(available - F.col("used"), F.lit(0).cast("long")).alias("remaining"), (F.col("used") <= available).alias("within_limit"), "parts")


def cut_to(text: Column, room: Column) -> Column:
    """The first ``room`` tokens' worth of characters: back to the last full stop if past the middle, else to the last space."""
    chars = F.floor(room * 4 / F.lit(1.3)).cast("int")
    head = F.substring(text, F.lit(1), chars)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    space = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when((F.instr(head, ".") > 0) & (stop > F.floor(chars / 2)), F.substring(head, F.lit(1), stop)).when(F.instr(head, " ") > 0, F.substring(head, F.lit(1), space)).otherwise(head)


def fitted(parts: DataFrame, by: str, priority: str, order: str, text: str = "text", may_cut: str | None = None, most: int = 4096, reserved: int = 512) -> DataFrame:
    """The parts of each prompt that fit its budget: by, order, place, tokens, spent, cut and text.

    Where all parts fit they stay in their order; else they come by priority, the
    highest first (ties in order), up to the first that doesn't fit. That one is
    cut to what is left if it may be (a column, default always) and more than
    WORTH tokens are left. Parts without text are empty; a prompt's parts are
    sorted in one task, with running sums.
    """
    room = most - reserved
    rows = parts.withColumn("tokens", token_estimate(F.coalesce(F.col(text), F.lit(""))))
    whole = F.sum("tokens").over(Window.partitionBy(by)) <= room
    ranked = rows.withColumn("_rank", F.when(whole, F.lit(None)).otherwise(F.col(priority)))
    window = Window.partitionBy(by).orderBy(F.desc("_rank"), order)
    ranked = ranked.withColumn("spent", F.sum("tokens").over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(window) - 1)
    before = F.col("spent") - F.col("tokens")
    first_out = (F.col("spent") > room) & (before <= room)
    worth = first_out & (F.lit(room) - before > WORTH) & (F.col(may_cut) if may_cut else F.lit(True))
    kept = ranked.where((F.col("spent") <= room) | worth).withColumn("cut", F.col("spent") > room)
    short = F.when(F.col("cut"), cut_to(F.col(text), F.lit(room) - before)).otherwise(F.coalesce(F.col(text), F.lit("")))
    return kept.select(by, order, F.col("place").cast("int").alias("place"), "tokens", F.least("spent", F.lit(room)).alias("spent"), "cut", short.alias("text"))


def assembled(fit: DataFrame, by: str) -> DataFrame:
    """One prompt per row: its fitting parts between empty lines."""
    return fit.groupBy(by).agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])).alias("text"))
