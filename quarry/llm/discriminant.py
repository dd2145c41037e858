"""Quality by a regularised quadratic discriminant over document statistics.

Each whole text gives a row of statistics: sizes, shares of kinds of characters,
repetition of words, pairs of words and lines, all through transforms that keep
their tails short. They are computed once, over all documents, and kept in a table
in the shared folder. The rows with a label give means and covariances of the two
classes: sums of products of whole numbers, which are added up where the rows are
and come out the same in any order. Covariances shrink towards the pooled one and
that towards a multiple of the identity; how far, and by how much the log-density
difference is tempered, is chosen by the log loss of five folds, each scored by a
fit without it. The factors of the chosen fit go to the tasks once; a score is the
difference of two Mahalanobis distances, with the log determinants and priors.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import encoded, pieces, text_buffers, trimmed, written

FIXED = 1 << 10  #: statistics are whole multiples of 1 / FIXED
FOLDS = 5
SHRINK = [(a, b) for a in (0.0, 0.1, 0.3, 0.6, 0.8) for b in (0.02, 0.1, 0.3)]  #: towards the pooled covariance, towards the identity
TEMPERS = (0.1, 0.2, 0.35, 0.5, 0.75, 1.0)
FEWEST = 4  #: rows of either class below which nothing is learnt

#: Kinds of bytes; letters beyond ASCII count by their lead bytes, upper case among them in Latin-1 only.
BLANK, LOWER, UPPER, DIGIT, STOP, MARK, SYMBOL, PIPE, OTHER, TAIL = range(10)


def kinds() -> np.ndarray:
    of = np.full(256, OTHER, np.uint8)
    for name, chars in ((BLANK, b" \t\n\v\f\r"), (DIGIT, b"0123456789"), (STOP, b".,;:'\"()-?"), (MARK, b"!"), (SYMBOL, b"#*$%&<>@^~=+_\\/{}[]`"), (PIPE, b"|")):
        of[list(chars)] = name
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1] = LOWER, UPPER
    of[0x80:0xC0], of[0xC0:] = TAIL, LOWER
    return of


KIND = kinds()
NAMES = [
    "words", "word_length", "upper", "digits", "stops", "marks", "symbols", "pipes", "others", "same_as_before", "new_words", "new_pairs", "lines", "same_lines", "longest_word", "caps_words",
]


def distinct_by(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Different keys of each document; doc ascends."""
    if not len(key):
        return np.zeros(n, np.int64)
    wide = int(key.max()) + 1
    if wide * n < 1 << 62:  # one number for both
        both = np.sort(doc * wide + key)
        return np.bincount(both[np.r_[True, both[1:] != both[:-1]]] // wide, minlength=n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    return np.bincount(d[np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])]], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """Rows of NAMES for texts (null: empty), as multiples of 1 / FIXED."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    kind = KIND[raw]
    latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] < 0x9F)) if len(raw) > 1 else np.zeros(0, np.int64)
    kind[latin] = UPPER
    of_byte = np.repeat(np.arange(n, dtype=np.int64) * (TAIL + 1), np.diff(offsets))
    count = np.bincount(of_byte + kind, minlength=n * (TAIL + 1)).reshape(n, TAIL + 1)
    # words: runs without blanks; a text's border ends one
    solid = kind != BLANK
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    begins = np.flatnonzero(solid & (border[:-1] | np.r_[True, ~solid[:-1]])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (border[1:] | np.r_[~solid[1:], True])) + 1 if len(raw) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, begins, "right") - 1
    words = np.bincount(doc, minlength=n)
    edges = np.empty(2 * len(begins) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = begins, ends, len(raw)
    name = encoded(raw, edges).indices.to_numpy()[::2].astype(np.int64) if len(begins) else np.zeros(0, np.int64)
    near = doc[1:] == doc[:-1]
    same = np.bincount(doc[1:][near & (name[1:] == name[:-1])], minlength=n)
    new_words = distinct_by(doc, name, n)
    pair = name[:-1][near] * (name.max() + 1) + name[1:][near] if len(name) > 1 else np.zeros(0, np.int64)
    pairs = np.bincount(doc[1:][near], minlength=n)
    new_pairs = distinct_by(doc[1:][near], pair, n)
    heads = np.r_[0, np.cumsum(kind != TAIL, dtype=np.int32)] if len(raw) else np.zeros(1, np.int64)
    length = heads[ends] - heads[begins]
    longest = np.zeros(n, np.int64)
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        longest[doc[first]] = np.maximum.reduceat(length, first)
    capitals, small = (np.r_[0, np.cumsum(kind == k, dtype=np.int32)] for k in (UPPER, LOWER))
    all_caps = (capitals[ends] - capitals[begins] >= 2) & (small[ends] == small[begins])
    caps = np.bincount(doc[all_caps], minlength=n)
    # lines with a word
    breaks = np.flatnonzero((raw == 10) | border[1:]) + 1 if len(raw) else np.zeros(0, np.int64)
    cuts = np.unique(np.r_[0, breaks])
    line = encoded(raw, cuts).indices.to_numpy().astype(np.int64) if len(cuts) > 1 else np.zeros(0, np.int64)
    used = np.diff(np.searchsorted(begins, cuts)) > 0 if len(cuts) > 1 else np.zeros(0, bool)
    line_doc = np.searchsorted(offsets, cuts[:-1][used], "right") - 1 if len(cuts) > 1 else np.zeros(0, np.int64)
    lines = np.bincount(line_doc, minlength=n)
    same_lines = lines - distinct_by(line_doc, line[used], n)

    w, chars = np.maximum(words, 1), np.maximum(count[:, :TAIL].sum(1) - count[:, BLANK], 1)
    share = lambda part, whole: np.log2(1 + 64 * part / whole)  # noqa: E731  0 to 6: even few of a kind show
    logs = np.log2(1 + words)
    rows = np.stack([
        logs, np.log2(1 + chars / w), share(count[:, UPPER], chars), share(count[:, DIGIT], chars), share(count[:, STOP], chars), share(count[:, MARK], w), share(count[:, SYMBOL], w), share(count[:, PIPE], w),
        share(count[:, OTHER], chars), share(same, w), np.log2(1 + new_words) - logs, np.log2(1 + new_pairs) - np.log2(1 + pairs), np.log2(1 + lines) - logs / 2, share(same_lines, np.maximum(lines, 1)),
        np.log2(1 + np.minimum(longest, 1 << 20)) / 2, share(caps, w),
    ], 1)
    return np.rint(rows * FIXED).astype(np.int32)


@dataclass
class Sums:
    """Rows of one class and fold: how many, their sum, and the sum of their products; whole numbers."""

    n: int
    first: np.ndarray
    second: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.first + other.first, self.second + other.second)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.first - other.first, self.second - other.second)

    @property
    def mean(self) -> np.ndarray:
        return self.first.astype(np.float64) / self.n / FIXED

    @property
    def spread(self) -> np.ndarray:
        m = self.first.astype(np.float64) / self.n
        return (self.second.astype(np.float64) / self.n - np.outer(m, m)) / FIXED**2


class Discriminant:
    """Log density difference of two Gaussians, from the factors of their covariances."""

    def __init__(self, low: Sums, high: Sums, pooled: float, ridge: float):
        both = (low.n * low.spread + high.n * high.spread) / (low.n + high.n)
        self.unit = np.sqrt(np.maximum(np.diag(both), 1e-4))
        scaled = lambda s: s / np.outer(self.unit, self.unit)
        shared, parts = scaled(both), []
        for c in (low, high):
            s = (1 - pooled) * scaled(c.spread) + pooled * shared
            s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            parts.append((c.mean / self.unit, np.linalg.inv(factor), np.log(np.diag(factor)).sum()))
        self.parts, self.prior = parts, np.log(high.n / low.n)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64) / FIXED / self.unit
        far = [0.5 * (((x - m) @ inverse.T) ** 2).sum(1) + half for m, inverse, half in self.parts]
        return far[0] - far[1]

    def chance(self, rows: np.ndarray, temper: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.prior + temper * self(rows), -500, 500)))


def described(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, x): statistics of every whole text, packed."""

    def run(batches):
        for batch in pieces(batches, "text"):
            x = statistics(batch.column(1)).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column].alias("id"), docs[text].alias("text")).mapInArrow(trimmed(run), f"id {kind}, x binary")


def rows_of(column: pa.Array) -> np.ndarray:
    x = column.to_pylist()
    return np.frombuffer(b"".join(x), "<i4").reshape(len(x), len(NAMES)) if x else np.zeros((0, len(NAMES)), np.int32)


def gathered(learnt: DataFrame) -> dict[tuple[int, int], Sums]:
    """Sums by fold and class: of each task, then of all; what reaches the driver is ten rows."""
    width = len(NAMES)

    def run(batches):
        held: dict[tuple[int, int], Sums] = {}
        for batch in batches:
            x = rows_of(batch.column(0)).astype(np.int64)
            fold, mark = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f, m in itertools.product(range(FOLDS), (0, 1)):
                mine = x[(fold == f) & (mark == m)]
                if len(mine):
                    part = Sums(len(mine), mine.sum(0), (mine.T @ mine).ravel())
                    held[f, m] = held[f, m] + part if (f, m) in held else part
        if held:
            rows = [{"fold": f, "mark": m, "n": s.n, "sums": [*s.first.tolist(), *s.second.tolist()]} for (f, m), s in held.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("fold", pa.int32()), ("mark", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = learnt.select("x", "fold", "mark").mapInArrow(run, "fold int, mark int, n long, sums array<long>")
    each = parts.select("fold", "mark", "n", F.posexplode("sums").alias("at", "v")).groupBy("fold", "mark", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[tuple[int, int], Sums] = {}
    for r in each.groupBy("fold", "mark").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v")).collect():
        v = np.array([float(x["v"]) for x in r["v"]])
        out[r["fold"], r["mark"]] = Sums(r["n"], v[:width], v[width:].reshape(width, width))
    return out


def fit(learnt: DataFrame) -> tuple[Discriminant, float] | None:
    """The discriminant and its temper, or None where a class has too few rows."""
    sums = gathered(learnt)
    none = Sums(0, np.zeros(len(NAMES)), np.zeros((len(NAMES), len(NAMES))))
    total = [sum((s for (_, m), s in sorted(sums.items()) if m == c), none) for c in (0, 1)]
    if min(t.n for t in total) < FEWEST:
        return None
    trials = {}
    for f, (pooled, ridge) in itertools.product(range(FOLDS), SHRINK):
        low, high = (total[c] - sums.get((f, c), none) for c in (0, 1))
        if min(low.n, high.n) >= FEWEST:
            trials[f, pooled, ridge] = Discriminant(low, high, pooled, ridge)

    def run(batches):
        loss = np.zeros((len(SHRINK), len(TEMPERS)))
        for batch in batches:
            x, fold, mark = rows_of(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for (f, *s), trial in trials.items():
                mine = fold == f
                if mine.any():
                    odds, sign = trial(x[mine]), np.where(mark[mine] == 1, -1.0, 1.0)
                    loss[SHRINK.index(tuple(s))] += [np.logaddexp(0, sign * (trial.prior + t * odds)).sum() for t in TEMPERS]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(loss.size, dtype=np.int32)), pa.array(np.rint(loss.ravel() * 1e6).astype(np.int64))], ["at", "loss"])

    pooled, ridge, temper = 0.3, 0.1, 0.35
    if trials:
        best = learnt.select("x", "fold", "mark").mapInArrow(run, "at int, loss long").groupBy("at").agg(F.sum("loss").alias("loss")).orderBy("loss", "at").first()
        (pooled, ridge), temper = SHRINK[best["at"] // len(TEMPERS)], TEMPERS[best["at"] % len(TEMPERS)]
    return Discriminant(*total, pooled, ridge), temper


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold).

    The fit reads every labelled row whose crc32(id as text) mod 4 is not 2; no
    sample is drawn. A label that repeats an id counts once, by its highest value;
    every row of ``docs`` with that id is learnt from. Scores see the text alone,
    all of it; null texts score as empty ones, equal texts alike, so that there are
    no ties to break. Rows without id are scored and have a null held_out; nulls
    among labels are left out. With under four rows of a class every score is the
    share of label 1, or a half without labels. An empty table gives no rows;
    other columns are not read.
    """
    held = written(described(docs, id_column, text))
    key = F.crc32(F.encode(F.col("id").cast("string"), "UTF-8"))
    marks = labels.select(labels[id_column].alias("id"), labels[label].cast("int").alias("mark")).where("id is not null and mark is not null").groupBy("id").agg(F.max("mark").alias("mark"))
    fold = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    learnt = written(held.join(marks, "id").where(key % 4 != 2).select("x", fold, (F.col("mark") > 0).cast("int").alias("mark")))
    model = fit(learnt)
    if model is None:
        n, ones = learnt.agg(F.count("mark"), F.coalesce(F.sum("mark"), F.lit(0))).first()
        flat = ones / n if n else 0.5

    def run(batches):
        for batch in batches:
            scores = model[0].chance(rows_of(batch.column(2)), model[1]) if model else np.full(batch.num_rows, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = held.select("id", (key % 4 == 2).alias("held_out"), "x").mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", id_column)
