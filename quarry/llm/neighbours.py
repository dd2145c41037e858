"""Nearest neighbours by shifted space-filling curves, with an exact completion.

Vectors are projected to a few dimensions along several random directions,
spread evenly by sampled quantiles, shifted, and ordered by their Hilbert keys:
one ordering per curve, each range-partitioned by Spark. A sliding window over
neighbouring key blocks scores every query against the vectors around it; the
windows of all curves merge and the reranked best give each query a threshold.

Where vectors have no structure, no window holds all neighbours. So the vectors
along the first curve also form groups, each within a radius of a centre, and a
query goes to the groups whose bound reaches its threshold: on clustered vectors
few, on structureless ones all. Bounds are looked at before anything moves; then
blocks of vectors and of queries meet in cells of bounded size, however large
the table. This makes the result exact at any data, and windows only decide how
much is read.

Equal vectors are one row throughout (with their smallest ids), so that a
vector that fills a third of the table costs no more than another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import drawn, written

DIMENSIONS, LEVELS, PIECES = 6, 8, 16
GROUPS = 4096  #: most groups, whose bounds every worker is sent


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (rows x dimensions) below 2^bits each."""
    x = points.T.astype(np.uint32).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ np.uint32(q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Projections, their quantiles in a sample, and the shift of each curve."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = min(DIMENSIONS, sample.shape[1])
        self.axes = [np.linalg.qr(rng.standard_normal((sample.shape[1], n)))[0] for _ in range(curves)]
        self.grid = [np.quantile(sample @ a, np.linspace(0, 1, 257)[1:-1], axis=0) for a in self.axes]
        self.shift = rng.random((curves, n))

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        y = x @ self.axes[curve]
        u = np.stack([np.searchsorted(g, c) for g, c in zip(self.grid[curve].T, y.T)], 1) / 256
        return hilbert(((u + self.shift[curve]) * (1 << (LEVELS - 1))).astype(np.int64), LEVELS)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in the order of the components."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k].astype(np.float64) * b[:, k]
    return out


def unpack(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 1))


def best(rows: np.ndarray, vids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best: higher scores first, ties to smaller ids."""
    order = np.lexsort((vids, -scores, rows))
    r = rows[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return order[rank < k]


def compared(q: np.ndarray, x: np.ndarray, vids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best in x for every query, as far as they reach ``floor``; products that are no number take no part."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    with np.errstate(over="ignore", invalid="ignore"):
        error = 4 * (q.shape[1] + 2) * 2.0**-53 if len(q) else 0.0
        norm, longest = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1).max()) if len(x) else 0.0
        for at in range(0, len(q), 1024):
            s = q[at : at + 1024] @ x.T
            least = floor[at : at + 1024]
            if s.shape[1] > k:
                least = np.maximum(least, np.partition(np.where(np.isnan(s), -np.inf, s), -k, 1)[:, -k])
            # the order of a matrix product's sums is not ours: it only preselects, with a margin above its error
            r, c = np.nonzero(~(s < (least - error * norm[at : at + 1024] * longest)[:, None]))
            score = exact(q[at + r], x[c])
            r, c, score = (v[~np.isnan(score)] for v in (r, c, score))
            keep = best(r, vids[c], score, k)
            out.append((at + r[keep], vids[c[keep]], score[keep]))
    return tuple(np.concatenate(p) for p in zip(*out))


FOUND = "qvid long, cvid long, score double"


def found_batch(qvid: np.ndarray, cvid: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qvid), pa.array(cvid), pa.array(score)], ["qvid", "cvid", "score"])


def distinct_vectors(df: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(packed, vid, ids, asked): usable vectors once, their smallest id, their k smallest ids, whether one is a query."""
    usable = df.where(
        "id is not null and vector is not null and size(vector) > 0"
    ).where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vector", lambda v: v != 0))
    sizes = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    usable = usable.where(F.size("vector") == (sizes["size"] if sizes else 0))

    def pack(batches):
        for batch in batches:
            held: dict[bytes, list] = {}
            flat = np.asarray(batch.column(1).flatten(), np.float64) + 0.0
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column(1))))
            for i, part, q in zip(batch.column(0).to_pylist(), np.split(flat, ends[:-1]) if len(ends) else [], batch.column(2).to_pylist()):
                of = held.setdefault(part.astype("<f8").tobytes(), [[], False])
                of[0].append(i)
                of[1] |= q
            rows = [(p, sorted(set(ids))[:k], q) for p, (ids, q) in held.items()]
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.list_(pa.int64())), pa.array(c, pa.bool_())], ["packed", "ids", "asked"])

    packed = usable.select("id", F.col("vector").cast("array<double>"), is_query.alias("asked")).mapInArrow(pack, "packed binary, ids array<long>, asked boolean")
    merged = packed.groupBy("packed").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k).alias("ids"), F.max("asked").alias("asked"))
    return merged.select("packed", F.element_at("ids", 1).alias("vid"), "ids", "asked")


def windows(vectors: DataFrame, curves: Curves, count: int, k: int, block: int, parts: int) -> DataFrame:
    """Best in the windows of all curves: three neighbouring key blocks around every query."""

    def keyed(batches):
        for batch in batches:
            x = unpack(batch.column(0))
            for c in range(count):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curves.keys(x, c)), *batch.columns], ["curve", "key", "packed", "vid", "asked"])

    ordered = vectors.select("packed", "vid", "asked").mapInArrow(keyed, "curve int, key long, packed binary, vid long, asked boolean")
    ordered = ordered.repartitionByRange(parts, "curve", "key", "vid").sortWithinPartitions("curve", "key", "vid")

    def slide(batches):
        near: list[tuple] = []
        rest: list[pa.RecordBatch] = []

        def scored(here):
            curve, x, vids, asked = here
            around = [b for b in near if b[0] == curve]
            at = np.flatnonzero(asked)
            if len(at):
                xs, vs = np.concatenate([b[1] for b in around]), np.concatenate([b[2] for b in around])
                r, v, s = compared(x[at], xs, vs, np.full(len(at), -np.inf), k)
                yield found_batch(vids[at][r], v, s)

        def blocks():
            have = 0
            for batch in batches:
                rest.append(batch)
                have += batch.num_rows
                while have >= block:
                    t = pa.Table.from_batches(rest)
                    yield from cut(t.slice(0, block))
                    rest[:] = t.slice(block).to_batches()
                    have -= block
            if have:
                yield from cut(pa.Table.from_batches(rest))

        def cut(t):
            curve = t.column(0).to_numpy()
            for a, b in zip(starts := np.flatnonzero(np.r_[True, curve[1:] != curve[:-1]]), np.r_[starts[1:], len(curve)]):
                s = t.slice(a, b - a)
                yield int(curve[a]), unpack(s.column(2).combine_chunks()), s.column(3).to_numpy(), s.column(4).to_numpy()

        for b in blocks():
            near.append(b)
            if len(near) > 1:
                yield from scored(near[-2])
            if len(near) > 2:
                near.pop(0)
        if near:
            yield from scored(near[-1])

    return ordered.mapInArrow(slide, FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    """(qvid, cvid, score, rank) of each query's k best among rows that may repeat; one exchange, sorted with spilling."""
    each = found.repartition("qvid").groupBy("qvid", "cvid").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qvid").orderBy(F.desc("score"), "cvid"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def completed(vectors: DataFrame, curves: Curves, sample: np.ndarray, floors: DataFrame, n: int, asked: int, k: int, group: int, ask: int) -> DataFrame:
    """Rows of (qvid, cvid, score) that reach a query's floor, from every group whose bound does.

    A group is a range of the first curve; its centre comes from the sample, its
    radius from all its vectors. A group of more than ``group`` vectors meets the
    queries in several cells.
    """
    spark = vectors.sparkSession
    wide, tall = min(GROUPS, max(1, -(-n // group))), max(1, -(-asked // ask))
    own = np.sort(curves.keys(sample, 0))
    cuts = np.unique(own[[len(own) * k // wide for k in range(1, wide)]]) if wide > 1 else np.zeros(0, np.int64)
    group_of = lambda x: np.searchsorted(cuts, curves.keys(x, 0), "right")
    centre = np.zeros((len(cuts) + 1, sample.shape[1]))
    at = group_of(sample)
    for g in np.unique(at):
        centre[g] = sample[at == g].mean(0)

    def place(batches):
        for batch in batches:
            x = unpack(batch.column(0))
            g = group_of(x)
            with np.errstate(over="ignore", invalid="ignore"):
                away = np.sqrt(((x - centre[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(away), *batch.columns], ["g", "away", "packed", "vid", "asked"])

    placed = written(vectors.select("packed", "vid", "asked").mapInArrow(place, "g int, away double, packed binary, vid long, asked boolean"))
    bounds = placed.groupBy("g").agg(F.max("away").alias("radius"), F.count("vid").alias("n")).collect()  # GROUPS rows at most
    radius, held = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
    for r in bounds:
        radius[r["g"]], held[r["g"]] = r["radius"], r["n"]
    pieces = -(-held // group)  # cells' worth of vectors, none in an empty group

    def reached(q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((q * q).sum(1))[:, None]
            most = q @ centre.T + norm * radius
            slack = 1e-9 * norm * (np.sqrt((centre * centre).sum(1)) + radius)
            return np.nonzero(~(most + slack < floor[:, None]) & (pieces > 0))

    def pairs(batches):
        for batch in batches:
            i, g = reached(unpack(batch.column(0)), batch.column(2).to_numpy())
            met = np.unique(np.stack([g, batch.column(3).to_numpy()[i]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(met[:, k].astype(np.int32)) for k in (0, 1)], ["g", "h"])

    def asks(batches):
        for batch in batches:
            i, g = reached(unpack(batch.column(0)), batch.column(2).to_numpy())
            for a in range(0, len(i), 2048):
                many = pieces[g[a : a + 2048]]
                row, to = np.repeat(i[a : a + 2048], many), np.repeat(g[a : a + 2048], many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                t = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(piece.astype(np.int32)), t.column(3), t.column(0), t.column(1), t.column(2), pa.array(np.ones(len(row), bool))], CELL)

    queries = placed.where("asked").join(floors, placed["vid"] == floors["qvid"], "left")
    queries = queries.select("packed", "vid", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.pmod(F.xxhash64("vid"), F.lit(tall)).cast("int").alias("h"))
    needed = queries.mapInArrow(pairs, "g int, h int").distinct()
    split = spark.createDataFrame([(g, int(p)) for g, p in enumerate(pieces)], "g int, pieces int")
    data = placed.join(F.broadcast(split), "g").withColumn("piece", F.pmod(F.xxhash64("vid", F.lit("piece")), F.col("pieces")).cast("int"))
    data = data.join(needed, "g").select("g", "piece", "h", "packed", "vid", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("asks"))

    def meet(t: pa.Table) -> pa.Table:
        mine = t.column("asks").to_numpy()
        q, d = t.filter(pa.array(mine)), t.filter(pa.array(~mine))
        out = [found_batch(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and d.num_rows:
            qx, qv, floor = unpack(q.column("packed").combine_chunks()), q.column("vid").to_numpy(), q.column("floor").to_numpy()
            for at in range(0, d.num_rows, 8192):
                part = d.slice(at, 8192)
                r, c, s = compared(qx, unpack(part.column("packed").combine_chunks()), part.column("vid").to_numpy(), floor, k)
                out.append(found_batch(qv[r], c, s))
        return pa.Table.from_batches(out)

    both = data.unionByName(queries.mapInArrow(asks, "g int, piece int, h int, packed binary, vid long, floor double, asks boolean"))
    return both.groupBy("g", "piece", "h").applyInArrow(meet, FOUND)


CELL = ["g", "piece", "h", "packed", "vid", "floor", "asks"]


def nearest(df: DataFrame, is_query: Column, k: int = 20, curves: int = 4, sample: int = 10_000, block: int = 1024, group: int = 8192, ask: int = 2048, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for every query row: query_id, rank, vec_id, score.

    is_query: a condition on a column ``id``. A query's own row is no candidate,
    equal vectors under other ids are; ties go to smaller ids. Rows with a null
    id, and vectors that are null, empty, all zero or hold null or non-finite
    components take no part; an empty table gives no rows. A repeated id counts
    once per different vector. Vectors of another length than the most frequent
    one (of equally frequent ones the longest) take no part, nor do pairs whose
    product overflows to no number. Columns other than the two are not read.
    sample: how many vectors fit the projections' quantiles and the groups'
    centres; group, ask: about how many vectors and queries meet in one task.
    """
    spark = df.sparkSession
    rows = df.select(df[id_column].cast("long").alias("id"), df[vector].alias("vector"))
    many = k + 1
    vectors = written(distinct_vectors(rows, is_query, many))
    n, asked = vectors.agg(F.count("vid"), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = [r[0] for r in drawn(vectors.select("vid", "packed"), "vid", sample).select("packed").collect()]
    fitted = np.frombuffer(b"".join(fitted), "<f8").reshape(len(fitted), -1)
    order = Curves(fitted, curves)
    parts = max(1, min(4096, curves * n // (16 * block) + 1))
    first = written(top(windows(vectors, order, curves, many, block, parts), many))
    floors = first.where(F.col("rank") == many).select("qvid", F.col("score").alias("floor"))
    rest = completed(vectors, order, fitted, floors, n, asked, many, group, ask)
    final = top(first.select("qvid", "cvid", "score").unionByName(rest), many)
    # ids of vectors that several rows hold; any other vector has its own
    copies = vectors.where(F.size("ids") > 1).select(F.col("vid").alias("cvid"), "ids")
    listed = final.join(copies, "cvid", "left").select("qvid", (-F.col("score")).alias("far"), F.coalesce("ids", F.array("cvid")).alias("ids"))
    listed = listed.groupBy("qvid").agg(F.collect_list(F.struct("far", "ids")).alias("found"))
    pairs = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["far"].alias("far"), i.alias("vec_id")))))
    listed = listed.select("qvid", F.slice(F.sort_array(pairs), 1, many).alias("near"))
    # a vector that many queries share goes to its queries piece by piece
    piece = F.pmod(F.xxhash64("id"), F.lit(PIECES)).cast("int").alias("piece")
    usable = rows.where(is_query).where(F.size("vector") > 0).select("id", F.transform(F.col("vector").cast("array<double>"), lambda v: v + F.lit(0.0)).alias("v"), piece)
    own = vectors.where("asked").select(F.col("vid").alias("qvid"), "packed")

    def unpacked(batches):
        for batch in batches:
            lists = [np.frombuffer(p, "<f8").tolist() for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.float64()))], ["qvid", "v"])

    dealt = own.mapInArrow(unpacked, "qvid long, v array<double>").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    queries = usable.distinct().join(dealt, ["v", "piece"]).select("id", "qvid")
    result = queries.join(listed, "qvid").select("id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("near"))
    result = result.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "x"))
    return result.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
