"""Reverse search: which kept predicates (subscriptions, saved searches) does a document fulfil?

A predicate is data: groups of ``field=value`` keys of which a document must hold
one each, groups it must not touch, groups of which some number must be touched,
and ranges of numbers. Whatever a predicate asks, one of its groups is necessary,
and the one that documents hold most rarely is its entry in the index: a row per
key of that group. Documents meet predicates by an equi-join on their own keys, and
the predicate is then checked in full, with no row compared that shares no key.
Predicates without a necessary group stand under a key that every document has; they
are the ones that every document has to be compared with anyway.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions.text import tokens
from quarry.operators.chunking import stable
from quarry.operators.search import BoolQuery, Filters, Match, MultiMatch, Options, QueryError, Range, Request, SavedSearch, Term, require

ANY = ""  #: the key of every document
SENT = 50_000  #: index rows that are sent to every task; more are joined by an exchange
CELL = 256  #: predicates of one key that a document meets as one row
PREDICATES = "needs array<array<string>>, never array<array<string>>, some array<array<string>>, least int, ranges array<struct<field: string, low: double, high: double>>"


def key(field: str, value: Column) -> Column:
    """Keys of one value (null if it is)."""
    return F.concat(F.lit(field + "="), value.cast("string"))


def keys(field: str, values: Column) -> Column:
    """Keys of an array of values, without nulls; null stays null."""
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: key(field, v))


# -- predicates as rows ------------------------------------------------------


def of_subscriptions(subscriptions: DataFrame, lists: dict[str, str]) -> DataFrame:
    """``subscriptions`` with the columns of a predicate; lists: list column -> field of documents. An absent list asks nothing, an empty one can't be fulfilled."""
    groups = F.filter(F.array(*[keys(field, F.col(c)) for c, field in lists.items()]), lambda g: g.isNotNull())
    none = F.array().cast("array<array<string>>")
    return subscriptions.select("*", groups.alias("needs"), none.alias("never"), none.alias("some"), F.lit(0).alias("least"), F.array().cast("array<struct<field: string, low: double, high: double>>").alias("ranges"))


RAW = "array<array<struct<field: string, value: string, text: boolean>>>"
PARSED = f"needs {RAW}, never {RAW}, some {RAW}, least int, ranges array<struct<field: string, low: string, high: string>>"


def parsed(request: Request, content: str = "content", date: str = "updated_at") -> tuple:
    """(needs, never, some, least, ranges) of a request: texts as they are, their words are found later."""
    needs, ranges = [], []

    def group(clause) -> list[tuple]:
        require(not isinstance(clause, Range), "a saved range has to be a must clause")
        if isinstance(clause, Match):
            return [(clause.field, clause.query, True)]
        return [(clause.field, str(clause.value).lower() if isinstance(clause.value, bool) else str(clause.value), False)]

    text = lambda v: None if v is None else str(v)
    b, m, f = request.bool_query or BoolQuery(must=(Range("", None, None),)), request.multi_match, request.filters
    for clause in b.must:
        if isinstance(clause, Range):
            ranges += [(clause.field, text(clause.gte), text(clause.lte))] if (clause.gte, clause.lte) != (None, None) else []
        else:
            needs.append(group(clause))
    needs += [[(field, m.query, True) for field in m.fields]] if m is not None else []
    needs += [[(content, request.query, True)]] if (request.query or "").strip() else []
    needs += [[("lower(category)", c.lower(), False) for c in f.categories]] if f.categories else []
    needs += [[("tags", t, False) for t in f.tags]] if f.tags else []
    needs += [[("repository", r, False) for r in f.repositories]] if f.repositories else []
    ranges += [("similarity", *map(text, f.similarity))] if f.similarity != (None, None) else []
    ranges += [(date, *map(text, f.dates))] if f.dates != (None, None) else []
    return needs, [group(c) for c in b.must_not], [group(c) for c in b.should], b.minimum_should_match, ranges


def of_parsed(rows: DataFrame) -> DataFrame:
    """Rows of PARSED as predicates: texts become the keys of their words, dates numbers of seconds."""
    keyed_ = lambda e: F.when(e["text"], F.transform(tokens(e["value"]), lambda w: F.concat(e["field"], F.lit("~"), w))).otherwise(F.array(F.concat(e["field"], F.lit("="), e["value"])))
    spread = lambda c: F.transform(c, lambda g: F.array_distinct(F.flatten(F.transform(g, keyed_))))
    number = lambda v: F.coalesce(v.try_cast("double"), F.unix_micros(v.try_cast("timestamp")) / 1e6)
    ranges = F.transform("ranges", lambda r: F.struct(r["field"].alias("field"), number(r["low"]).alias("low"), number(r["high"]).alias("high")))
    return rows.select(*[c for c in rows.columns if c not in ("needs", "never", "some", "least", "ranges")], *[spread(c).alias(c) for c in ("needs", "never", "some")], "least", ranges.alias("ranges"))


def of_saved(spark: SparkSession, saved: dict[str, Request], **kw) -> DataFrame:
    """A row per request that holds exactly where ``matches`` keeps a document: search_id and its predicate."""
    return of_parsed(spark.createDataFrame([(i, *parsed(r, **kw)) for i, r in saved.items()], f"search_id string, {PARSED}"))


# -- documents as keys -------------------------------------------------------


def held(values: Iterable[str] = (), lists: Iterable[str] = (), texts: Iterable[str] = ()) -> Column:
    """All keys of a document: ``field=value`` of values and lists, ``field~word`` of texts, and the category in lower case."""
    parts = [F.array(key(c, F.col(c))) for c in values] + [F.array(key("lower(category)", F.lower("category")))] * ("category" in values) + [keys(c, F.col(c)) for c in lists]
    worded = lambda c: F.transform(tokens(F.col(c)), lambda w: F.concat(F.lit(c + "~"), w))
    parts += [worded(c) for c in texts]
    whole = F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]) if parts else F.array().cast("array<string>")
    return F.array_distinct(F.filter(whole, lambda k: k.isNotNull()))


def numbers(fields: dict[str, Column]) -> Column:
    """The numbers that ranges are checked on, by field."""
    made = [x for f, c in fields.items() for x in (F.lit(f), c.cast("double"))]
    return F.create_map(*made) if made else F.create_map().cast("map<string,double>")


def frequencies(docs: DataFrame, of: Column) -> DataFrame:
    """(key, n) of the documents that hold it: what says how rare a key is."""
    return docs.select(F.explode(of).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


# -- the index ---------------------------------------------------------------


def indexed(predicates: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``predicates`` with ``entry`` (the rarest necessary group) and ``key``, a row per key of it.

    known: frequencies of keys; without them the shortest group is taken as the rarest.
    """
    union = F.array_distinct(F.flatten("some"))
    groups = F.when(F.col("least") > 0, F.concat("needs", F.array(union))).otherwise(F.col("needs"))
    groups = F.transform(groups, F.array_distinct)
    rows = predicates.withColumn("_groups", groups)
    if known is None:
        entry = F.element_at(F.array_sort(F.transform("_groups", lambda g: F.struct(F.size(g).alias("n"), g.alias("g")))), 1)["g"]
        rows = rows.withColumn("entry", F.when(F.size("_groups") > 0, entry))
    else:
        rows = rows.withColumn("_id", F.struct(*[F.col(c) for c in predicates.columns]))
        each = rows.where(F.size("_groups") > 0).select(F.xxhash64(F.to_json("_id")).alias("h"), F.to_json("_id").alias("j"), F.posexplode("_groups").alias("at", "g"))
        cost = each.select("h", "j", "at", "g", F.explode_outer("g").alias("key")).join(known, "key", "left").groupBy("h", "j", "at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cost"), F.first("g").alias("g"))
        best = cost.groupBy("h", "j").agg(F.min_by("g", F.struct("cost", "at")).alias("entry"))
        rows = rows.withColumn("h", F.xxhash64(F.to_json("_id"))).withColumn("j", F.to_json("_id")).join(best, ["h", "j"], "left").drop("h", "j", "_id")
    rows = rows.drop("_groups")
    return rows.withColumn("key", F.explode(F.coalesce("entry", F.array(F.lit(ANY)))))


def fulfilled(asks: Column, of: Column, values: Column) -> Column:
    """Whether the keys and numbers of a document fulfil the predicate in the struct ``asks``."""
    touches = lambda g: F.coalesce(F.arrays_overlap(g, of), F.lit(False))
    inside = lambda r: F.coalesce((r["low"].isNull() | (F.element_at(values, r["field"]) >= r["low"])) & (r["high"].isNull() | (F.element_at(values, r["field"]) <= r["high"])) & F.element_at(values, r["field"]).isNotNull(), F.lit(False))
    return F.forall(asks["needs"], touches) & ~F.exists(asks["never"], touches) & (F.size(F.filter(asks["some"], touches)) >= asks["least"]) & F.forall(asks["ranges"], inside)


def celled(index: DataFrame, ids: list[str]) -> DataFrame:
    """A row per key of an index and about CELL of its predicates: ``_key``, ``_asks`` (they, as structs) and ``_asked`` (all keys that they name)."""
    hot = index.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > CELL)  # at most a row for CELL rows of the index
    cell = F.coalesce(F.pmod(F.xxhash64(*ids, "needs", "some"), F.ceil(F.col("_n") / CELL)), F.lit(0))
    asks = F.struct(F.struct(*ids).alias("ids"), "needs", "never", "some", "least", "ranges", "entry")
    cells = index.join(F.broadcast(hot), "key", "left").groupBy(F.col("key").alias("_key"), cell.alias("_cell")).agg(F.collect_list(asks).alias("_asks"))
    named = F.transform("_asks", lambda a: F.flatten(F.concat(a["needs"], a["never"], a["some"])))
    return cells.select("_key", "_asks", F.array_distinct(F.flatten(named)).alias("_asked"))


def matched(docs: DataFrame, index: DataFrame, of: Column, ids: list[str], values: Column | None = None, small: bool | None = None) -> DataFrame:
    """Columns ``ids`` of every predicate and all of every document that fulfils it, each pair once.

    A document meets the predicates of a key as cells: its keys are cut to those that
    a cell names once, and each predicate of the cell is checked against these few.
    index: of :func:`indexed`. small: whether the index is sent to all tasks; by
    default it is counted. Works on streams of documents as on tables.
    """
    if small is None:
        small = index.count() <= SENT
    sent = F.broadcast if small else lambda df: df
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), of.alias("_of"), (numbers({}) if values is None else values).alias("_values"))
    dealt = row.withColumn("_key", F.explode(F.concat("_of", F.array(F.lit(ANY)))))
    # most keys of a text are no predicate's entry: they go before a row with all keys is made for each
    dealt = dealt.join(sent(index.select(F.col("key").alias("_key")).distinct()), "_key", "left_semi")
    met = dealt.join(sent(celled(index, ids)), "_key").withColumn("_met", F.array_intersect("_asked", "_of"))
    # a document may hold several keys of an entry: the first one speaks
    once = lambda a: a["entry"].isNull() | (F.col("_key") == F.array_min(F.array_intersect(a["entry"], F.col("_met"))))
    hits = F.filter("_asks", lambda a: once(a) & fulfilled(a, F.col("_met"), F.col("_values")))
    return met.select(F.explode(F.transform(hits, lambda a: a["ids"])).alias("_ids"), "_doc").select("_ids.*", "_doc.*")


def tallied(docs: DataFrame, subscriptions: DataFrame, lists: dict[str, str], ids: list[str], value: str, several: tuple[str, ...] = ("tags",)) -> DataFrame:
    """(ids, n, total): how many documents fulfil each subscription, and the sum of their ``value``, without a row per pair.

    Subscriptions that ask for the same are one predicate. Those that ask by the same
    lists can't tell documents apart that hold the same in these fields: for each
    such set of lists, documents are grouped by what they hold that anything asks for, and
    predicates meet the groups. lists: as of :func:`of_subscriptions`; several: fields that are arrays.
    """
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.col(c).cast("array<string>"), lambda v: v.isNotNull())))
    subs = subscriptions.select(*ids, *[clean(c).alias(c) for c in lists])
    kind = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in lists])
    subs = subs.withColumn("_kind", kind).withColumn("_asked", F.to_json(F.struct(*lists)))
    asked = stable(subs.groupBy("_kind", "_asked").agg(*[F.first(c).alias(c) for c in lists]))
    held_ = docs.select(F.col(value).alias("_value"), *[clean(f).alias(f) if f in several else F.col(f).cast("string").alias(f) for f in lists.values()])
    for c, f in lists.items():
        if f not in several:
            wanted = asked.select(F.explode(c).alias(f)).distinct().withColumn("_in", F.lit(True))
            held_ = held_.join(wanted, f, "left").withColumn(f, F.when(F.col("_in"), F.col(f))).drop("_in")
    each = held_.join(F.broadcast(asked.select("_kind").distinct()))  # at most a row for each set of lists
    own = lambda v: F.concat("_kind", F.lit("/"), v)
    owned = lambda c: F.transform(c, own)
    for k, f in enumerate(lists.values(), 1):
        counts = F.substring("_kind", k, 1) == "1"
        each = each.where(~counts | F.col(f).isNotNull()).withColumn(f, F.when(counts, owned(f) if f in several else own(F.col(f))))
    groups = stable(each.groupBy("_kind", *lists.values()).agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("total")))
    of = held(["_kind", *(f for f in lists.values() if f not in several)], [f for f in lists.values() if f in several])
    predicates = asked.select("_asked", F.array("_kind").alias("_kinds"), *[owned(c).alias(c) for c in lists])
    index = stable(indexed(of_subscriptions(predicates, {"_kinds": "_kind"} | lists), frequencies(groups, of)))
    found = matched(groups, index, of, ["_asked"]).groupBy("_asked").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return subs.select(*ids, "_asked").join(found, "_asked").groupBy(*ids).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# -- saved searches as data --------------------------------------------------

SAVED = "search_id string, user_id string, name string, description string, request string, created_at timestamp, updated_at timestamp"
KINDS = {"match": Match, "term": Term, "range": Range}


def to_json(request: Request) -> str:
    clause = lambda c: {"kind": next(k for k, v in KINDS.items() if isinstance(c, v))} | asdict(c)
    b, m = request.bool_query, request.multi_match
    out = {"query": request.query, "filters": asdict(request.filters), "options": asdict(request.options)}
    out["bool_query"] = b and {"must": [*map(clause, b.must)], "should": [*map(clause, b.should)], "must_not": [*map(clause, b.must_not)], "minimum_should_match": b.minimum_should_match}
    out["multi_match"] = m and asdict(m)
    return json.dumps(out, sort_keys=True, default=str)


def from_json(text: str) -> Request:
    """The request again, checked as a new one is."""
    try:
        d = json.loads(text)
        clause = lambda c: KINDS[c["kind"]](**{k: v for k, v in c.items() if k != "kind"})
        b, m, f = d.get("bool_query"), d.get("multi_match"), d.get("filters") or {}
        tuples = lambda x: {k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}
        return Request(
            d.get("query"), m and MultiMatch(**tuples(m)), b and BoolQuery(*(tuple(map(clause, b[k])) for k in ("must", "should", "must_not")), b["minimum_should_match"]),
            Filters(**tuples(f)), Options(**(d.get("options") or {})),
        )
    except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
        raise QueryError("malformed request") from e


def of_json(rows: DataFrame, request: str = "request", **kw) -> DataFrame:
    """``rows`` with the predicate of their request in place of it; parsed and checked where the rows are."""
    names = [c for c in rows.columns if c != request]
    group = pa.list_(pa.list_(pa.struct([("field", pa.string()), ("value", pa.string()), ("text", pa.bool_())])))
    kinds = [group, group, group, pa.int32(), pa.list_(pa.struct([("field", pa.string()), ("low", pa.string()), ("high", pa.string())]))]

    def run(batches):
        for batch in batches:
            made = [parsed(from_json(r), **kw) for r in batch.column(len(names)).to_pylist()]
            own = [pa.array(list(c), k) for c, k in zip(zip(*made) if made else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *own], [*names, "needs", "never", "some", "least", "ranges"])

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)
    return of_parsed(rows.select(*names, request).mapInArrow(run, fields + PARSED))


class SavedSearches:
    """Saved searches in a store: kept, listed by user, and matched against documents that arrive.

    A user's search is named once: saving under the name again updates it, and keeps
    when it was created.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        from quarry.sources.store import Store

        self.spark, self.store = spark, Store(spark, path, SAVED, "user_id", ("created_at", "search_id"), buckets)

    def rows(self, searches: list[SavedSearch]) -> DataFrame:
        made = [(s.user_id.strip(), s.name.strip(), s.description, to_json(s.request)) for s in searches]
        rows = self.spark.createDataFrame(made, "user_id string, name string, description string, request string")
        return rows.select(F.sha2(F.concat_ws("\x1f", "user_id", "name"), 256).substr(1, 32).alias("search_id"), "*", F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))

    def save(self, searches: list[SavedSearch]) -> None:
        """Keeps searches; of several under one name the last one."""
        last = list({(s.user_id.strip(), s.name.strip()): s for s in searches}.values())
        base = self.store.manifest()
        fresh = self.rows(last).alias("f")
        # the store replaces by user: what else these users keep goes along
        old = self.store.read(version=base["version"] or None).join(fresh.select("user_id").distinct(), "user_id", "left_semi")
        kept = old.join(fresh.select("search_id"), "search_id", "left_anti").select(*[c.split()[0] for c in SAVED.split(", ")])
        dated = fresh.join(old.select("search_id", F.col("created_at").alias("before")), "search_id", "left").withColumn("created_at", F.coalesce("before", "created_at")).drop("before")
        self.store.replace(kept.unionByName(dated), base=base)

    def delete(self, user_id: str, name: str) -> bool:
        base = self.store.manifest()
        held_ = self.store.rows_of(user_id)
        rest = held_.where(F.col("name") != name)
        n, m = held_.count(), rest.count()
        if n > m:
            self.store.replace(rest, self.spark.createDataFrame([(user_id,)], "user_id string"), base=base)
        return n > m

    def of_user(self, user_id: str) -> DataFrame:
        """A user's searches, oldest first; one bucket is read."""
        return self.store.rows_of(user_id)

    def predicates(self, **kw) -> DataFrame:
        """All kept searches as predicates, with search_id, user_id and name."""
        return of_json(self.store.read().select("search_id", "user_id", "name", "request"), **kw)
