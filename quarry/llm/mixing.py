"""Mixing sources to target weights through a domain - language - source tree.

Every node's capacity is the tokens below it times the epochs allowed. From
the root down, a node's budget is shared among its children by weight; a child
that can't take its share is filled, and what it leaves goes to its siblings by
weight, up to the level at which all fits. A node takes less than its share
only when its whole subtree is full, so shortages stay among siblings before
they reach an ancestor's.

A leaf's tokens are taken from seeded epochs: each epoch is the leaf's
documents in the order of a keyed hash, and the budget is spent on whole epochs
and then on the longest prefix of the next one that fits. Prefix sums run over
hash ranges first, so that only the one range in which a prefix ends is sorted,
however large a source is.

Budgets are whole tokens; all of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import written
from quarry.llm.quality_rules import words_of

LEVELS = ["domain", "lang", "source"]
FEW = 200_000  #: leaves, of about 100 bytes, that a worker may be sent
RANGES = 3  #: hex digits of the hash that name a range


def shared(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to rows of (parent..., capacity, weight, above): water-filling among siblings.

    In the order of capacity per weight, a child is full if the budget left by the
    full ones before it would give it more than its capacity. Siblings of equal
    capacity and weight are one step of that order, so a window holds as many
    rows as a parent has different capacities: with t tokens below it these are
    at most the root of 2t for each weight, however many siblings there are.
    """
    order = [F.col("capacity") / F.col("weight"), F.col("weight")]
    steps = nodes.groupBy(*parent, "capacity", "weight", "above").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("above") - F.coalesce(F.sum(F.col("capacity") * F.col("n")).over(before), F.lit(0))) / F.sum(F.col("weight") * F.col("n")).over(on)
    steps = steps.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("capacity"))
    # after the first step that is not full none is, and these levels only fall: the first one holds for all
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    amount = F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.col("weight") * open_level)).cast("long")
    steps = steps.select(*parent, "capacity", "weight", amount.alias("budget"))
    return nodes.join(steps, [*parent, "capacity", "weight"])


def hash_of(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key).cast("binary"))


def chosen(
    df: DataFrame, weights: dict[tuple[str, ...], int], share: float, epochs: int, seed: int = 1, tokens: Column | None = None, domain: Column | None = None,
    id_column: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None,
) -> DataFrame:
    """The rows chosen, one per document and epoch: domain, lang, source, n_tokens, epoch, and ``row`` with the columns ``carry`` (default: all) of ``df``.

    weights: whole numbers of 1 or more by path, (domain,), (domain, lang) or
    (domain, lang, source); a path without one weighs 1. share: the budget as a
    part of all tokens; epochs: how often a document may be taken at most.
    tokens: a native count (default: words); domain: default ``web``. Null langs,
    sources or domains are the node ``?``; null and empty texts have no tokens
    and are never chosen. A row is a document: rows that repeat an id have equal
    hashes and are ordered by their place in the table, rows without id are
    hashed by that place. A text of any length is one document that fits a
    budget or doesn't. An empty table gives no rows. Other columns ride along
    unread, whatever their names.
    """
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights must be 1 at least")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    body = F.coalesce(df[text], F.lit(""))
    docs = df.select(
        F.struct(*[df[f"`{c}`"] for c in (df.columns if carry is None else carry)]).alias("row"), df[id_column].cast("string").alias("key"), name(domain if domain is not None else F.lit("web")).alias("domain"),
        name(df[lang]).alias("lang"), name(df[source]).alias("source"), (tokens if tokens is not None else F.size(words_of(body))).cast("long").alias("n_tokens"),
    ).where("n_tokens > 0")
    # words are counted and rows numbered once: what comes after reads this table, budgets and prefix sums a few columns of it
    number = F.monotonically_increasing_id()
    docs = written(docs.withColumn("number", number).withColumn("key", F.coalesce("key", F.concat(F.lit("?"), F.col("number").cast("string")))))
    slim = docs.select("key", "number", *LEVELS, "n_tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("held")).withColumn("capacity", F.col("held") * epochs)
    plan = None
    for depth in (1, 2, 3):
        at = LEVELS[:depth]
        weight = F.lit(1)
        for path, w in weights.items():
            if len(path) == depth:
                weight = F.when(F.array(*at) == F.array(*map(F.lit, path)), F.lit(w)).otherwise(weight)
        nodes = leaves.groupBy(*at).agg(F.sum("capacity").alias("capacity"), F.sum("held").alias("held")).withColumn("weight", weight)
        if plan is None:
            total = leaves.agg(F.floor(F.sum("held") * F.lit(float(share)))).first()[0]
            nodes = nodes.withColumn("above", F.lit(total).cast("long"))
        else:
            nodes = nodes.join(plan.select(*at[:-1], F.col("budget").alias("above")), at[:-1])
        plan = shared(nodes, at[:-1])
    leaf = plan.select(*LEVELS, "held", F.floor(F.col("budget") / F.col("held")).cast("int").alias("whole"), "budget")
    leaf = written(leaf.select(*LEVELS, "whole", (F.col("budget") - F.col("whole") * F.col("held")).alias("left")))
    few = leaf.count() <= FEW
    near = lambda t: F.broadcast(t) if few else t
    # the epoch begun: sums by range of the hash, then by document in the one range where the budget ends
    placed = lambda t: t.withColumn("hash", hash_of(seed, F.col("whole") + 1, F.col("key"))).withColumn("range", F.substring("hash", 1, RANGES))
    begun = placed(slim.join(near(leaf.where("left > 0")), LEVELS))
    run = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = begun.groupBy(*LEVELS, "range", "left").agg(F.sum("n_tokens").alias("n")).withColumn("so_far", F.coalesce(F.sum("n").over(run), F.lit(0)))
    ends = written(ranges.where("so_far <= left and so_far + n > left").select(*LEVELS, F.col("range").alias("end"), "so_far"))
    upto = F.col("so_far") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("hash", "number").rowsBetween(Window.unboundedPreceding, 0))
    edge = begun.join(near(ends), LEVELS).where("range = end").withColumn("upto", upto).where("upto <= left").groupBy(*LEVELS).agg(F.max(F.struct("hash", "number")).alias("last"))
    bounds = written(leaf.join(ends, LEVELS, "left").join(edge, LEVELS, "left").drop("so_far"))
    # a document is in the prefix up to its leaf's last one, or below the range where nothing of it fits
    full = placed(docs.join(near(bounds), LEVELS))
    inside = (F.col("left") > 0) & F.when(F.col("last").isNotNull(), F.struct("hash", "number") <= F.col("last")).when(F.col("end").isNotNull(), F.col("range") < F.col("end")).otherwise(True)
    times = F.col("whole") + F.when(inside, 1).otherwise(0)
    return full.withColumn("times", times).where("times > 0").select(*LEVELS, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"), "row")


def mixed(df: DataFrame, weights: dict[tuple[str, ...], int], share: float, epochs: int, id_column: str = "doc_id", **more) -> DataFrame:
    """Ids chosen by :func:`chosen`: id, domain, lang, source, n_tokens, epoch."""
    return chosen(df, weights, share, epochs, id_column=id_column, carry=[id_column], **more).select(F.col("row")[id_column].alias(id_column), *LEVELS, "n_tokens", "epoch")


def level_sql(name: str, source: str, parent: str, keys: str) -> str:
    """Water-filling of one level: table ``source`` of (keys, capacity, held, weight, above)."""
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"capacity / weight, {keys}"
    return f"""
{name}_l AS (SELECT *, (above - coalesce(sum(capacity) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER ({part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {source}),
{name} AS (SELECT *, CASE WHEN level * weight >= capacity THEN capacity
    ELSE floor(weight * max(CASE WHEN level * weight < capacity THEN level END) OVER ({part}))::BIGINT END AS budget FROM {name}_l)"""


def oracle(domain: str, weight: str, share: float, epochs: int, seed: int) -> str:
    """DuckDB SQL of ``mixed``; domain and weight are SQL expressions, the latter over domain, lang, source (null above)."""
    return rf"""
WITH d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
docs AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS held, (sum(n_tokens) * {epochs})::BIGINT AS capacity FROM docs GROUP BY ALL),
n1 AS (SELECT domain, NULL AS lang, NULL AS source, sum(capacity)::BIGINT AS capacity, sum(held)::BIGINT AS held,
    (SELECT floor(sum(held) * {share!r}::DOUBLE)::BIGINT FROM leaves) AS above FROM leaves GROUP BY domain),
m1 AS (SELECT *, {weight} AS weight FROM n1), {level_sql("b1", "m1", "", "domain")},
n2 AS (SELECT domain, lang, NULL AS source, sum(capacity)::BIGINT AS capacity, sum(held)::BIGINT AS held, any_value(b1.budget) AS above
    FROM leaves JOIN (SELECT domain, budget FROM b1) b1 USING (domain) GROUP BY domain, lang),
m2 AS (SELECT *, {weight} AS weight FROM n2), {level_sql("b2", "m2", "domain", "lang")},
n3 AS (SELECT domain, lang, source, capacity, held, b2.budget AS above FROM leaves JOIN (SELECT domain, lang, budget FROM b2) b2 USING (domain, lang)),
m3 AS (SELECT *, {weight} AS weight FROM n3), {level_sql("b3", "m3", "domain, lang", "source")},
leaf AS (SELECT domain, lang, source, held, budget, (budget // held)::INTEGER AS whole, budget - (budget // held) * held AS rest FROM b3),
e AS (SELECT docs.*, whole + 1 AS epoch, rest, md5('{seed}:' || (whole + 1) || ':' || doc_id) AS h FROM docs JOIN leaf USING (domain, lang, source)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS upto FROM e)
SELECT doc_id, domain, lang, source, n_tokens, epoch::INTEGER AS epoch FROM p WHERE upto <= rest
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, whole + 1))::INTEGER AS epoch FROM docs JOIN leaf USING (domain, lang, source)
"""
