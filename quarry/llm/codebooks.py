"""Vector codes by Elkan's Lloyd iteration on integer parts.

Vectors become integers and are cut into equal parts, each with a codebook of its
own. What the iteration knows of a vector stays with it in a table that every
round replaces: for each part its entry, an upper bound of the distance to it, and
a lower bound of the distance to every entry. When entries move, bounds shift by
the movement; a part is compared with an entry only if neither the bounds nor the
triangle inequality between entries rule that out, strictly and with rounding on
the safe side, so that ties are always compared. Comparisons are exact integers,
and equal distances go to the lower index.

Entries are the only thing that all tasks share: 4 x 256 at most. Their sums are
added up by task, part and entry before they are exchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import dropped, native_count, trimmed, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SMALL = 100_000  #: groups of a label that are sent to every task; more are joined by an exchange
LONG = (1 << 63) - 1
ROWS = 8192, 1 << 18  #: least and most rows of a task, as far as the cluster's cores ask for many
STEP = 1.02  #: between neighbouring codes of a lower bound


def integer(x: float) -> int:
    """floor(SCALE x), exactly, for any finite double."""
    return int(x) * SCALE if abs(x) >= 1 << 52 else math.floor(x * SCALE)


def bytes_of(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def binaries(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


@dataclass
class Numbers:
    """How integers of at most ``largest`` are worked with so that nothing overflows: doubles, longs, or Python's own."""

    largest: int
    width: int  #: of a part

    @property
    def most(self) -> int:
        return 4 * max(self.width, 1) * max(self.largest, 1) ** 2

    @property
    def kind(self) -> type:
        return np.int64 if self.most < 1 << 62 else object

    def pack(self, x: np.ndarray) -> pa.Array:
        """Rows of doubles as rows of integers, in bytes."""
        if self.kind is object:
            return pa.array([",".join(str(integer(c)) for c in r).encode() for r in x.tolist()], pa.binary())
        return binaries(np.floor(x * SCALE).astype("<i4"))

    def unpack(self, column: pa.Array) -> np.ndarray:
        if self.kind is object:
            rows = [[int(c) for c in r.split(b",")] for r in column.to_pylist()]
            return np.array(rows, dtype=object).reshape(len(rows), PARTS, self.width)
        return bytes_of(column, "<i4").astype(np.int64).reshape(len(column), PARTS, self.width)

    def squares(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Exact squared distances of every row of x from every row of y."""
        if self.most < 1 << 53:  # every partial sum is an integer that a double holds
            a, b = x.astype(np.float64), y.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
        return np.stack([squared(x - c) for c in y], 1)


def squared(d: np.ndarray) -> np.ndarray:
    return (d * d).sum(1)


def below(squares: np.ndarray) -> np.ndarray:
    """Roots, or a little less: what a few roundings may be off."""
    return np.sqrt(squares.astype(np.float64)) * (1 - 1e-12)


def above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + 1e-12)


def coded(bounds: np.ndarray, unit: float) -> np.ndarray:
    """Lower bounds in a byte each, on a logarithmic scale up to ``unit``: never more than they were."""
    with np.errstate(divide="ignore"):
        q = np.floor(255 + np.log(np.maximum(bounds, 0) / unit) / math.log(STEP) - 1e-6)
    return np.clip(q, 0, 255).astype(np.uint8)


def bound_of(unit: float) -> np.ndarray:
    """The bound of every code; 0 says nothing."""
    return np.r_[0.0, unit * STEP ** (np.arange(1, 256) - 255.0)]


class Round:
    """What a task knows in one round: the entries of each part, how far each has moved, and the distances between them."""

    def __init__(self, entries: list[np.ndarray], moved: list[np.ndarray] | None, numbers: Numbers):
        self.entries, self.moved, self.numbers = entries, moved, numbers
        self.compared = 0  #: distances computed
        if numbers.kind is not object:
            self.half = [below(numbers.squares(e, e)) / 2 for e in entries]
            for h in self.half:
                np.fill_diagonal(h, np.inf)
            self.nearest = [h.min(1) for h in self.half]

    def first(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, upper bound and lower bounds of every row, from all distances; integers beyond a long are always compared so, without bounds."""
        squares = self.numbers.squares(x, self.entries[part])
        self.compared += squares.size
        if squares.dtype == object:
            return np.array([min(range(len(r)), key=r.__getitem__) for r in squares.tolist()]), np.zeros(len(x)), np.zeros(squares.shape)
        at = squares.argmin(1)
        return at, above(squares[np.arange(len(x)), at]), below(squares)

    def again(self, x: np.ndarray, part: int, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the bounds of the round before."""
        entries, half = self.entries[part], self.half[part]
        at, upper = at.copy(), (upper + self.moved[part][at]) * (1 + 1e-12)
        lower = np.maximum(lower - self.moved[part], 0) * (1 - 1e-12)
        meets = np.flatnonzero(upper >= self.nearest[part][at])
        if len(meets):
            x, old, low = x[meets], at[meets], lower[meets]
            new, best = old.copy(), squared(x - entries[old])
            up = above(best)
            low[np.arange(len(x)), old] = below(best)
            self.compared += len(x)
            for c in range(len(entries)):
                near = np.flatnonzero((new != c) & (old != c) & (low[:, c] <= up) & (half[new, c] <= up))
                if len(near):
                    squares = squared(x[near] - entries[c])
                    self.compared += len(near)
                    low[near, c] = below(squares)
                    nearer = (squares < best[near]) | ((squares == best[near]) & (c < new[near]))
                    won = near[nearer]
                    best[won], new[won], up[won] = squares[nearer], c, above(squares[nearer])
            at[meets], upper[meets], lower[meets] = new, up, low
        return at, upper, lower

    def step(self, batch: pa.RecordBatch, unit: float) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Integers of a batch and, by part, its entries, upper and lower bounds."""
        x = self.numbers.unpack(batch.column(2))
        if self.moved is None or self.numbers.kind is object:
            found = [self.first(x[:, p], p) for p in range(PARTS)]
        else:
            code, upper = bytes_of(batch.column(3), np.uint8), bytes_of(batch.column(4), "<f8")
            lower = bytes_of(batch.column(5), np.uint8).reshape(len(x), PARTS, -1)
            scale = bound_of(unit)
            found = [self.again(x[:, p], p, code[:, p].astype(np.int64), upper[:, p], scale[lower[:, p]]) for p in range(PARTS)]
        return x, *(list(c) for c in zip(*found))


def summed(state: DataFrame, numbers: Numbers, entries: list[np.ndarray]) -> list[np.ndarray]:
    """The entries as the floored means of their parts; unused ones stay. Sums are whole numbers of any size."""

    def of_task(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            x, code = numbers.unpack(batch.column(0)), bytes_of(batch.column(1), np.uint8)
            for p in range(PARTS):
                order = np.argsort(code[:, p], kind="stable")
                c = code[order, p]
                starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else []
                sums = np.add.reduceat(x[order, p], starts, 0) if len(c) else []
                for e, n, s in zip(c[starts].tolist() if len(c) else [], np.diff(np.r_[starts, len(c)]).tolist(), sums):
                    have = held.setdefault((p, e), [0, [0] * numbers.width])
                    held[p, e] = [have[0] + n, [a + int(b) for a, b in zip(have[1], s)]]
        if held:
            yield pa.RecordBatch.from_pylist([{"part": p, "entry": e, "n": n, "sums": ",".join(map(str, s))} for (p, e), (n, s) in held.items()], SUMS)

    def together(t: pa.Table) -> pa.Table:
        total = [sum(c) for c in zip(*([int(v) for v in s.split(",")] for s in t.column("sums").to_pylist()))]
        row = {"part": t.column("part")[0].as_py(), "entry": t.column("entry")[0].as_py(), "n": sum(t.column("n").to_pylist()), "sums": ",".join(map(str, total))}
        return pa.Table.from_pylist([row], SUMS)

    made = [e.copy() for e in entries]
    for r in state.select("v", "code").mapInArrow(trimmed(of_task), SUM).groupBy("part", "entry").applyInArrow(together, SUM).collect():  # entries, not rows
        made[r["part"]][r["entry"]] = [int(v) // r["n"] for v in r["sums"].split(",")]
    return made


SUM = "part int, entry int, n long, sums string"
SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.string())])


def started(kept: DataFrame, numbers: Numbers) -> list[np.ndarray]:
    """The parts of the smallest ids' vectors, ascending."""
    ids = [r[0] for r in kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    some = kept.where(F.col("vec_id") <= ids[-1]) if ids else kept
    rows = some.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").select("v").collect()  # ENTRIES at most
    x = numbers.unpack(pa.array([bytes(r[0]) for r in rows], pa.binary()))
    return [x[:, p].copy() for p in range(PARTS)]


def vector_codes(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per usable row of ``df``: vec_id, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty or holds null or non-finite components take
    no part, nor do vectors of another length than the most frequent one (of
    equally frequent ones the longest). A length that four does not divide is
    filled up with zeros. Components become floor(1024 x), however large; errors
    beyond a long are its largest value. Equal distances go to the lower index.
    The first codebook is made of the smallest ids, each once: of rows that repeat
    an id, the one whose packed integers come first; rows without id are coded but
    make no entry unless there is no id at all. Fewer than 256 ids make a smaller
    codebook. Null labels are one label, repeated rows get equal codes, an empty
    table gives no rows, and columns other than the three are not read.
    """
    rows = df.select(df[id_column].alias("vec_id"), df[label].alias("label"), df[vector].cast("array<double>").alias("v"))
    fine = rows.where("v is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    largest = F.array_max(F.transform("v", F.abs))
    found = fine.groupBy(F.size("v").alias("size")).agg(F.count("v").alias("n"), F.max(largest).alias("largest")).orderBy(F.desc("n"), F.desc("size")).first()
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, label_error long, codebooks_sha256 string"
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    size, n = found["size"], found["n"]
    numbers = Numbers(integer(found["largest"]) + 1, -(-size // PARTS))
    unit = 2.0 * min(numbers.largest, 1 << 40) * math.sqrt(numbers.width)  # no distance is larger

    def pack(batches):
        for batch in batches:
            x = np.zeros((batch.num_rows, PARTS * numbers.width))
            x[:, :size] = np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers.pack(x)], ["vec_id", "label", "v"])

    tasks = max(-(-n // ROWS[1]), min(-(-n // ROWS[0]), 4 * df.sparkSession.sparkContext.defaultParallelism))
    ids = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    state = written(fine.where(F.size("v") == size).mapInArrow(pack, f"{ids}, v binary").repartition(tasks))
    entries, moved = started(state, numbers), None

    def bounded(entries, moved):
        def run(batches):
            now = Round(entries, moved, numbers)
            for batch in batches:
                if batch.num_rows:
                    _, at, upper, lower = now.step(batch, unit)
                    kept = [binaries(np.stack(at, 1).astype(np.uint8)), binaries(np.stack(upper, 1)), binaries(np.concatenate([coded(b, unit) for b in lower], 1))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], *kept], ["vec_id", "label", "v", "code", "upper", "lower"])

        return run

    for _ in range(ROUNDS):
        after = written(state.mapInArrow(trimmed(bounded(entries, moved)), f"{ids}, v binary, code binary, upper binary, lower binary"))
        dropped(state)
        state, before = after, entries
        entries = summed(state, numbers, before)
        moved = [np.zeros(len(a)) if numbers.kind is object else above(squared(a - b)) for a, b in zip(entries, before)]
    sha = sha256(",".join(str(c) for e in entries for r in e.tolist() for c in r).encode()).hexdigest()

    def final(batches):
        now = Round(entries, moved, numbers)
        for batch in batches:
            if batch.num_rows:
                x, at, *_ = now.step(batch, unit)
                error = sum(squared(x[:, p] - entries[p][at[p]]) for p in range(PARTS))
                code = [r.tobytes().hex() for r in np.stack(at, 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code), pa.array([min(int(e), LONG) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    result = written(state.mapInArrow(trimmed(final), f"{ids}, code string, error long"))
    dropped(state)
    by_label = result.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    if native_count(by_label) <= SMALL:
        by_label = F.broadcast(by_label)
    joined = result.alias("r").join(by_label.alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    return joined.select("vec_id", "r.label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def oracle() -> str:
    """DuckDB SQL of the iteration, all distances compared; every round is a pair of common tables."""
    nearest = """a{r} AS MATERIALIZED (SELECT rn, p, min({{'d': d, 'e': e}}) AS m FROM (SELECT x.rn, x.p, c.e,
        list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN e{r} c USING (p)) GROUP BY rn, p)"""
    means = """e{n} AS MATERIALIZED (SELECT o.p, o.e, coalesce(f.v, o.v) AS v FROM e{r} o LEFT JOIN (SELECT p, e, list(q ORDER BY k) AS v FROM (
        SELECT p, e, k, ((s - ((s % n) + n) % n) // n)::BIGINT AS q FROM (SELECT x.p, a.m.e AS e, k, sum(x.v[k])::BIGINT AS s, count(*) AS n
        FROM a{r} a JOIN x USING (rn, p), unnest(range(1, len(x.v) + 1)) t(k) GROUP BY ALL)) GROUP BY p, e) f USING (p, e))"""
    rounds = ",\n".join(f"{nearest.format(r=r)},\n{means.format(r=r, n=r + 1)}" for r in range(ROUNDS)) + ",\n" + nearest.format(r=ROUNDS)
    return f"""
WITH g AS (SELECT row_number() OVER () AS rn, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT rn, vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM g, unnest(range({PARTS})) t(p)),
e0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, v FROM x WHERE vec_id IN (SELECT DISTINCT vec_id FROM g ORDER BY vec_id LIMIT {ENTRIES})),
{rounds},
f AS (SELECT rn, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rn),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS sha FROM e{ROUNDS})
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha FROM b) AS codebooks_sha256 FROM f JOIN g USING (rn)
"""
