"""Exact vector search, filters, boolean and multi-field queries, facets and pages."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from quarry.functions.text import tokens
from quarry.functions.vector import cosine
from quarry.operators.ordered import numbered

FIELDS = ("title", "content", "tags", "path", "repository")
CATEGORIES = ("tutorial", "how-to", "reference", "explanation")


class QueryError(ValueError):
    """A request that can't be run."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise QueryError(message)


@dataclass(frozen=True)
class SearchConfig:
    max_results: int = 10
    min_similarity: float = 0.0
    category: str | None = None

    def __post_init__(self):
        require(self.max_results >= 1, "max_results must be 1 at least")
        require(0.0 <= self.min_similarity <= 1.0, "min_similarity must lie in [0, 1]")


def semantic_search(chunks: DataFrame, query: list[float], config: SearchConfig = SearchConfig(), vector: str = "embedding", ties: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Chunks nearest to a query vector by cosine, best first; ties in the order of columns ``ties``.

    Chunks whose vector has no cosine with the query are left out, or fail the
    search if strict. The plan is a scan with its category filter pushed down, a
    projection, and a top-k per task that meet in one place.
    """
    require(len(query) > 0, "the query has no vector")
    rows = chunks if config.category is None else chunks.where(F.col("category") == config.category)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("similarity", cosine(F.col(vector), q, strict)).where(F.col("similarity") >= config.min_similarity)
    return scored.orderBy(F.desc("similarity"), *ties).limit(config.max_results)


VECTORS = 1 << 16  #: vectors of a block, at most
COMPONENTS = 1 << 22  #: and their numbers, about
STEP = 4096  #: vectors of a matrix product; a side of more is cut into four blocks at least, for the tasks


def batch_search(chunks: DataFrame, queries: DataFrame, k: int, chunk_id: str, query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query", block: int | None = None) -> DataFrame:
    """The k nearest chunks of every row of ``queries``: blocks of VECTORS chunks meet blocks of about ``block`` queries.

    All pairs are compared by matrix products; what may be among the k best of a
    block is computed again as :func:`cosine` does, term by term, so that equal
    vectors tie. A task holds two blocks and the products of 256 queries with STEP
    chunks; a vector is exchanged once per block of the other side, in the type it
    has, and k rows per query and block of chunks.
    """
    require(k >= 1, "k must be 1 at least")
    whole = lambda c: (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull())
    held = lambda df, c: F.col(c).cast("array<float>" if df.schema[c].dataType == ArrayType(FloatType(), df.schema[c].dataType.containsNull) else "array<double>")
    asked = queries.select(query_id, held(queries, query_vector).alias("_q")).where(whole(F.col("_q")))
    rows = chunks.select(chunk_id, held(chunks, vector).alias("_v")).where(whole(F.col("_v")))
    blocks, cells = parts(asked, "_q", block or VECTORS), parts(rows, "_v", VECTORS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    met = min(4 * blocks * cells, 1 << 15) if blocks * cells > 1 else 1  # four times, so that few meet in one task by chance
    left = rows.withColumn("_cell", dealt(cells, chunk_id, "_v")).withColumn("_block", every(blocks)).repartition(met, "_cell", "_block")
    right = asked.withColumn("_block", dealt(blocks, query_id, "_q")).withColumn("_cell", every(cells)).repartition(met, "_cell", "_block")
    schema = StructType([StructField(query_id, queries.schema[query_id].dataType), StructField(chunk_id, chunks.schema[chunk_id].dataType), StructField("similarity", DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = nearest(a.column(chunk_id), a.column("_v"), b.column("_q"), k)
        return pa.table([b.column(query_id).take(found[0]), a.column(chunk_id).take(found[1]), found[2]], [query_id, chunk_id, "similarity"])

    scored = left.groupBy("_cell", "_block").cogroup(right.groupBy("_cell", "_block")).applyInArrow(run, schema)
    best = Window.partitionBy(query_id).orderBy(F.desc("similarity"), chunk_id)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_id, chunk_id, "similarity", "rank")


def parts(rows: DataFrame, vector: str, most: int) -> int:
    """Blocks of a side: of ``most`` rows and COMPONENTS numbers, or smaller ones where few would be left to do at a time."""
    n, size = rows.agg(F.count("*"), F.sum(F.size(vector))).first()
    return max(1, -(-n // most), -(-(size or 0) // COMPONENTS), min(4, n // STEP))


def nearest(ids: pa.ChunkedArray, vectors: pa.ChunkedArray, asked: pa.ChunkedArray, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(place of the query, place of the vector, cosine) of each query's k nearest vectors, ties to smaller ids."""
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    # sums in the order of the components: those of ``dot``, bit by bit
    dot_ = lambda x, y: np.cumsum(np.multiply(x, y, dtype=np.float64), axis=1)[:, -1] + 0.0
    usual = lambda v: (v > 1e-100) & (v < 1e100)
    out: list[tuple] = []

    def of_size(lists: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(pc.list_value_length(lists).to_numpy() == size)
        x = pc.list_flatten(lists.take(pa.array(at))).to_numpy().reshape(-1, size)
        n = np.concatenate([np.empty(0), *(np.sqrt(dot_(y, y)) for y in (x[c : c + STEP] for c in range(0, len(x), STEP)))])
        good = n > 0
        return at[good], x[good], n[good]

    def unit(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.concatenate([np.where(usual(m)[:, None], y / m[:, None], 0.0).astype(np.float32) for y, m in ((x[c : c + STEP], n[c : c + STEP]) for c in range(0, len(x), STEP))])

    for size in pc.unique(pc.list_value_length(asked)).to_pylist():
        with np.errstate(all="ignore"):
            at, x, n = of_size(vectors, size)
            q_at, q, qn = of_size(asked, size)
            # of equal vectors the k first ones count, and no others
            seen: dict[bytes, int] = {}
            kept = []
            for j in np.argsort(place[at], kind="stable"):
                own = x[j].tobytes()
                seen[own] = seen.get(own, 0) + 1
                if seen[own] <= k:
                    kept.append(j)
            at, x, n = at[kept], x[kept], n[kept]
            if not len(x) or not len(q):
                continue
            units, q_units, odd_x, odd_q = unit(x, n), unit(q, qn), ~usual(n), ~usual(qn)
            # more than two products of unit vectors in single precision are off together
            near = (size + 8) * 2.0**-22
            for a in range(0, len(q), 256):
                some = slice(a, a + 256)
                limit = np.full(len(q[some]), -np.inf)
                i, j, value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                for c in range(0, len(x), STEP):
                    products = q_units[some] @ units[c : c + STEP].T
                    odd = np.flatnonzero(odd_x[c : c + STEP])
                    products[:, odd] = -np.inf
                    width = products.shape[1]
                    if not c and width > k:
                        limit = np.partition(products, width - k, axis=1)[:, width - k].astype(np.float64)
                        limit[odd_q[some]] = -np.inf
                    more = products >= (limit - near).astype(np.float32)[:, None]
                    more[:, odd] = True
                    more[odd_q[some]] = True
                    new_i, new_j = np.divmod(np.flatnonzero(more), width)  # faster than in two dimensions
                    if not len(new_i):
                        continue
                    new_j += c
                    pieces = [(a + new_i[p : p + 65536], new_j[p : p + 65536]) for p in range(0, len(new_i), 65536)]
                    exact = np.concatenate([dot_(q[y], x[z]) / (qn[y] * n[z]) for y, z in pieces])
                    valid = ~np.isnan(exact) & (qn[a + new_i] * n[new_j] > 0)
                    i, j, value = (np.concatenate([u, v[valid]]) for u, v in ((i, new_i), (j, new_j), (value, exact)))
                    order = np.lexsort((place[at[j]], -value, i))
                    i, j, value = i[order], j[order], value[order]
                    number = np.arange(len(i)) - np.searchsorted(i, i)
                    last = number == k - 1
                    limit[i[last]] = value[last]
                    first = number < k
                    i, j, value = i[first], j[first], value[first]
                out.append((q_at[a + i], at[j], value))
    parts_ = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return tuple(map(pa.array, parts_))


@dataclass(frozen=True)
class SavedSearch:
    """A search that a user keeps; creating or updating one checks its names and the request itself."""

    user_id: str
    name: str
    request: "Request"
    description: str | None = None

    def __post_init__(self):
        require(bool(self.name.strip()), "a saved search needs a name")
        require(bool(self.user_id.strip()), "a saved search needs a user")

    def updated(self, **changes) -> "SavedSearch":
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


# -- clauses -----------------------------------------------------------------


@dataclass(frozen=True)
class Match:
    """The field shares a word with the query."""

    field: str
    query: str

    def column(self) -> Column:
        c = F.col(self.field)
        return F.arrays_overlap(tokens(c), tokens(F.lit(self.query)))


@dataclass(frozen=True)
class Term:
    """The field is the value, or its array holds it."""

    field: str
    value: object
    listed: bool = False

    def column(self) -> Column:
        return F.array_contains(F.col(self.field), F.lit(self.value)) if self.listed else F.col(self.field) == F.lit(self.value)


@dataclass(frozen=True)
class Range:
    """The field lies between two inclusive bounds, either of which may be left out."""

    field: str
    gte: float | None = None
    lte: float | None = None

    def column(self) -> Column:
        c = F.lit(True)
        c = c & (F.col(self.field) >= F.lit(self.gte)) if self.gte is not None else c
        return c & (F.col(self.field) <= F.lit(self.lte)) if self.lte is not None else c


@dataclass(frozen=True)
class BoolQuery:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    minimum_should_match: int = 0

    def __post_init__(self):
        require(0 <= self.minimum_should_match <= len(self.should), "minimum_should_match exceeds the should clauses")
        require(bool(self.must or self.should or self.must_not), "a bool query needs a clause")

    def column(self) -> Column:
        no = lambda c: F.coalesce(c.column(), F.lit(False))
        # must clauses stand as they are, so that scans take them as filters
        out = reduce(lambda a, b: a & b, [c.column() for c in self.must] + [~no(c) for c in self.must_not], F.lit(True))
        if self.should:
            out = out & (self.hits() >= self.minimum_should_match)
        return out

    def hits(self) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(c.column(), F.lit(False)).cast("int") for c in self.should], F.lit(0))


@dataclass(frozen=True)
class MultiMatch:
    """Score of a query over several fields: the boosts of those that share a word with it."""

    query: str
    fields: tuple[str, ...] = FIELDS
    boosts: dict[str, float] = field(default_factory=dict)
    allowed: tuple[str, ...] = FIELDS

    def __post_init__(self):
        require(bool(self.query.strip()), "the query is blank")
        require(bool(self.fields) and set(self.fields) <= set(self.allowed), "unknown field")
        require(all(0 < b < float("inf") for b in self.boosts.values()), "boosts must be positive and finite")

    def score(self) -> Column:
        return reduce(lambda a, b: a + b, [F.when(Match(f, self.query).column(), float(self.boosts.get(f, 1.0))).otherwise(0.0) for f in self.fields])


@dataclass(frozen=True)
class Filters:
    categories: tuple[str, ...] = ()
    similarity: tuple[float | None, float | None] = (None, None)
    dates: tuple[object, object] = (None, None)
    tags: tuple[str, ...] = ()
    repositories: tuple[str, ...] = ()

    def __post_init__(self):
        require({c.lower() for c in self.categories} <= set(CATEGORIES), "unknown category")
        low, high = self.similarity
        require(all(x is None or 0.0 <= x <= 1.0 for x in self.similarity), "similarities lie in [0, 1]")
        require(low is None or high is None or low <= high, "similarity range is reversed")
        require(None in self.dates or self.dates[0] <= self.dates[1], "date range is reversed")

    def column(self, date: str = "updated_at") -> Column:
        parts = [F.lower("category").isin(*[c.lower() for c in self.categories])] if self.categories else []
        parts += [F.arrays_overlap(F.col("tags"), F.array(*map(F.lit, self.tags)))] if self.tags else []
        parts += [F.col("repository").isin(*self.repositories)] if self.repositories else []
        parts += [Range("similarity", *self.similarity).column()] if self.similarity != (None, None) else []
        parts += [Range(date, *self.dates).column()] if self.dates != (None, None) else []
        return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class Options:
    max_results: int = 20
    offset: int = 0
    snippets: bool = True
    highlight: bool = False
    group_by: str | None = None

    def __post_init__(self):
        require(1 <= self.max_results <= 100, "max_results must lie in [1, 100]")
        require(self.offset >= 0, "offset is negative")


@dataclass(frozen=True)
class Request:
    """A search over a document table; one of query, multi_match and bool_query at least."""

    query: str | None = None
    multi_match: MultiMatch | None = None
    bool_query: BoolQuery | None = None
    filters: Filters = Filters()
    options: Options = Options()

    def __post_init__(self):
        require(self.multi_match is not None or self.bool_query is not None or bool((self.query or "").strip()), "a query, a multi_match or a bool_query is needed")

    def matches(self, docs: DataFrame, content: str = "content") -> DataFrame:
        """Matching rows with a ``score``; unlimited."""
        rows = docs.where(self.filters.column())
        score = F.lit(0.0)
        if self.bool_query is not None:
            rows, score = rows.where(self.bool_query.column()), score + self.bool_query.hits()
        if self.multi_match is not None:
            score = score + self.multi_match.score()
            rows = rows.where(self.multi_match.score() > 0)
        if (self.query or "").strip():
            hit = Match(content, self.query).column()
            rows, score = rows.where(hit), score + F.size(F.array_intersect(tokens(F.col(content)), tokens(F.lit(self.query))))
        return rows.withColumn("score", score)

    def run(self, docs: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
        """A page of matches, best first, ties by key; with the total and whether more follow."""
        found, o = self.matches(docs, content), self.options
        if o.group_by:
            first = Window.partitionBy(o.group_by).orderBy(F.desc("score"), key)
            found = found.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
        total = found.count()
        page = found.orderBy(F.desc("score"), key).offset(o.offset).limit(o.max_results)
        if o.snippets:
            page = page.withColumn("snippet", F.substring(content, 1, 200))
        if o.highlight and self.query:
            page = page.withColumn("highlight", highlighted(F.col(content), self.query))
        return page.withColumn("total", F.lit(total)).withColumn("has_more", F.lit(o.offset + o.max_results < total))


def highlighted(text: Column, query: str) -> Column:
    """``text`` with the query's words in bold."""
    names = "|".join(r"\Q" + w + r"\E" for w in query.split())
    return F.regexp_replace(text, rf"(?i)\b({names})\b", "**$1**")


def facets(found: DataFrame, date: str = "updated_at") -> DataFrame:
    """Counts over all matches: (facet, value, count) by category, similarity band and month."""
    band = F.when(F.col("similarity") >= 0.8, "high").when(F.col("similarity") >= 0.6, "medium").otherwise("low")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), v.cast("string").alias("value")) for n, v in (("category", F.col("category")), ("similarity", band), ("month", F.date_format(date, "yyyy-MM")))]))
    return found.select(each.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("count"))


def cursor(last_id: int, last_ts: str, forward: bool = True) -> str:
    return base64.b64encode(json.dumps({"last_id": last_id, "last_timestamp": last_ts, "forward": forward}).encode()).decode()


def keyset_page(rows: DataFrame, size: int, after: str | None, key: str, ts: str) -> DataFrame:
    """The next rows in descending (ts, key) after a cursor, or the ones before it; no offset is scanned."""
    forward = True
    if after:
        try:
            at = json.loads(base64.b64decode(after, validate=True))
            last, stamp, forward = at["last_id"], at["last_timestamp"], at["forward"]
        except (ValueError, KeyError, TypeError) as e:
            raise QueryError("malformed cursor") from e
        at_ts, t, k = F.lit(stamp).cast("timestamp"), F.col(ts), F.col(key)
        rows = rows.where((t < at_ts) | ((t == at_ts) & (k < last)) if forward else (t > at_ts) | ((t == at_ts) & (k > last)))
    page = rows.orderBy(F.desc(ts), F.desc(key)).limit(size) if forward else rows.orderBy(ts, key).limit(size)
    return page if forward else page.orderBy(F.desc(ts), F.desc(key))


def batches(found: DataFrame, size: int, *order: Column) -> DataFrame:
    """Numbers rows in deliveries of ``size``, with whether more follow; for a client that takes results in parts.

    Ranges of the order number their own rows, so that no task holds all results.
    """
    require(1 <= size <= 100, "size must lie in [1, 100]")
    each = numbered(found, list(order), name="_rank")
    made = each.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("int")).drop("_rank")
    last = made.agg(F.max("batch").alias("_last"))
    return made.join(F.broadcast(last)).withColumn("has_more", F.col("batch") < F.col("_last")).drop("_last")  # one row


def evaluated(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: precision and recall at k, reciprocal rank. results: query, doc, rank; relevant: query, doc."""
    truth = relevant.select("query", "doc").distinct()
    known = truth.groupBy("query").agg(F.count("*").alias("n_relevant"))
    hits = results.join(truth.withColumn("hit", F.lit(1)), ["query", "doc"], "left")
    each = hits.groupBy("query").agg(F.count("*").alias("n"), F.sum(F.when(F.col("rank") <= k, F.col("hit"))).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    joined = known.join(each, "query", "full_outer").na.fill(0, ["n", "found", "n_relevant"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return joined.select(
        "query", share(F.col("found"), F.least(F.lit(k), F.col("n"))).alias("precision"), share(F.col("found"), F.col("n_relevant")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.col("n").alias("results"),
    )


def evaluated_by_label(results: DataFrame, labels: DataFrame, k: int, alone: bool = True) -> DataFrame:
    """:func:`evaluated` where what shares the query's label is relevant to it: labels are counted and compared, no pairs are made.

    results: query, doc, rank; labels: doc, label, of queries too. A query isn't relevant to itself;
    one whose label nothing else has counts as a miss, or not at all unless ``alone``.
    """
    known = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    known = known if alone else known.where("n_relevant > 0")
    asked = labels.select(F.col("doc").alias("query"), F.col("label").alias("q_label"))
    hits = results.join(labels, "doc").join(asked, "query").withColumn("hit", F.when((F.col("label") == F.col("q_label")) & (F.col("doc") != F.col("query")), 1))
    each = hits.groupBy("query", "q_label").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("hit"))), F.lit(0)).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    joined = each.join(known, F.col("q_label") == F.col("label"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return joined.select(
        "query", share(F.col("found"), F.least(F.lit(k), F.col("n"))).alias("precision"), share(F.col("found"), F.col("n_relevant")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.col("n").alias("results"))


def evaluation(each: DataFrame) -> DataFrame:
    """Means over queries, and the share of those without results."""
    return each.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg((F.col("results") == 0).cast("double")).alias("zero_result_rate"), F.avg("results").alias("avg_results"))
