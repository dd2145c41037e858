"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are the words of a fixed list, words and word beginnings mined from one
half of a bounded sample of labelled rows, a few patterns, and the rows' own
marks, which are one voter like any other. The label model (expectation
maximisation over one hidden class per row) estimates on the other half how
often each votes in either class; what voters share beyond the class is
estimated too, and correlated voters weigh less. A logistic classifier over
counts of lexicon hits, patterns and the lexicon's voters is then trained on the
posterior labels of all sampled rows, and scores every whole text.

The sample, at most ``sample`` rows, is the only part of the corpus that the fit
reads. Counts of its words stay in Spark; the driver gets the words that pass as
voters, and each row's votes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import drawn, dropped, pieces, trimmed, written

#: Words that vote whatever the sample says.
WORDS = ["bastard", "clown", "disgusting", "dumb", "fool", "freak", "hate", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless"]
TOKEN = re.compile(r"[^\W\d_]+")
PATTERNS = [re.compile(p) for p in (r"!!", r"\b[A-Z]{4,}\b", r"\*\*\*|%%%|\$\$\$", r"(?i)\byou\b", r"\?\?|\?!")]
LEADS = (5, 6, 7)
GAIN = 15.0  #: a likelihood ratio that chance reaches for about one word in 10^4


def names(word: str) -> tuple[str, ...]:
    """What can vote for a word: itself and its beginnings."""
    return (word, *("^" + word[:n] for n in LEADS if len(word) > n))


def read(text: str) -> tuple[Counter, list[int]]:
    """Words of a text with their counts, and how often each pattern occurs."""
    return Counter(TOKEN.findall(text.lower())), [sum(1 for _ in p.finditer(text)) for p in PATTERNS]


@dataclass
class Model:
    lexicon: dict[str, int]  #: voter number by name
    weights: np.ndarray  #: of dense() and of every voter
    rates: np.ndarray  #: of a vote in class 0 and 1
    shared: np.ndarray  #: weight left to a voter beside correlated ones

    def hits(self, words: Counter, seen: dict[str, tuple[int, ...]]) -> tuple[int, Counter]:
        """Tokens on which any voter votes, and hits of each voter."""
        total, each = 0, Counter()
        for word, n in words.items():
            if (found := seen.get(word)) is None:
                if len(seen) > 200_000:
                    seen.clear()
                found = tuple(v for v in (self.lexicon.get(x) for x in names(word)) if v is not None)
                if len(word) < 64:
                    seen[word] = found
            if found:
                total += n
                for v in found:
                    each[v] += n
        return total, each

    def score(self, text: str, seen: dict) -> float:
        words, patterns = read(text)
        total, each = self.hits(words, seen)
        x = dense(total, sum(words.values()), patterns)
        s = float(x @ self.weights[: len(x)]) + sum(self.weights[len(x) + v] for v in each)
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def dense(total: int, words: int, patterns: list[int]) -> np.ndarray:
    share = total / max(words, 1)
    return np.array([1.0, total >= 1, total >= 2, total >= 3, min(np.log1p(total), 3.0), min(20 * share, 2.0), *(min(np.log1p(p), 3.0) / 3 for p in patterns)])


def label_model(votes: np.ndarray, marks: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 per row, rates (voter, class; the mark last), and weights under correlation.

    votes: rows x voters, 1 or 0 (silent); marks: the rows' own labels, a voter whose
    rates are learnt too and that starts the iteration.
    """
    posterior = np.clip(marks * 0.9 + 0.05, 0.05, 0.95)
    every = np.column_stack([votes, marks]).astype(np.float64)
    shared = np.ones(every.shape[1])
    for step in range(rounds):
        q = np.stack([1 - posterior, posterior])
        rates = np.clip((q @ every + 0.5) / (q.sum(1, keepdims=True) + 1), 1e-4, 1 - 1e-4)
        base = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        if step == 3:
            # what two voters share within a class: residual correlation
            left = sum(((every - rates[c]) * q[c][:, None]).T @ (every - rates[c]) for c in (0, 1))
            deviation = np.sqrt(np.diag(left).clip(1e-9))
            tied = np.abs(left / np.outer(deviation, deviation)) - np.eye(len(left))
            shared = 1 / (1 + np.where(tied > 0.3, tied, 0).sum(1))
        posterior = posteriors(votes, marks, rates, shared, base)
    return posterior, rates.T, shared


def posteriors(votes: np.ndarray, marks: np.ndarray, rates: np.ndarray, shared: np.ndarray, base: float) -> np.ndarray:
    """Of class 1, by row; rates: class x voter, the mark last. Votes and silence both speak, at each voter's rates."""
    every = np.column_stack([votes, marks]).astype(np.float64)
    say = every * np.log(rates[1] / rates[0]) + (1 - every) * np.log((1 - rates[1]) / (1 - rates[0]))
    return 1 / (1 + np.exp(-np.clip(say @ shared + np.log(base / (1 - base)), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Newton steps for soft labels y with a ridge penalty per column."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = np.abs(step).max()
        w += step * min(1.0, 5 / max(size, 1e-9))
        if size < 1e-4:
            break
    return w


@dataclass
class Row:
    """A sampled row: numbers of the lexicon's voters, tokens with a vote, pattern counts, tokens, mark, and whether it mined."""

    voters: list[int]
    total: int
    patterns: list[int]
    words: int
    mark: int
    mined: bool


def fit(rows: list[Row], lexicon: dict[str, int]) -> Model:
    marks = np.array([r.mark for r in rows], np.float64)
    mined = np.array([r.mined for r in rows], bool)
    votes = np.zeros((len(rows), len(lexicon) + len(PATTERNS)))
    for k, r in enumerate(rows):
        votes[k, r.voters] = 1
        votes[k, len(lexicon) :] = np.array(r.patterns) > 0
    width = len(dense(0, 1, [0] * len(PATTERNS)))
    weights = np.zeros(width + len(lexicon))
    weights[[0, 1, 2]] = [-4.0, 1.0, 6.0]  # without labels: two words of the list
    rates, shared = np.full((votes.shape[1] + 1, 2), 0.5), np.ones(votes.shape[1] + 1)
    judged = ~mined if 0 < marks[~mined].sum() < (~mined).sum() else np.ones(len(rows), bool)
    if 0 < marks[judged].sum() < judged.sum():
        found, rates, shared = label_model(votes[judged], marks[judged])
        posterior = posteriors(votes, marks, rates.T, shared, float(np.clip(found.mean(), 1e-3, 1 - 1e-3)))
        x = np.array([dense(r.total, r.words, r.patterns) for r in rows])
        weights = logistic(np.hstack([x, votes[:, : len(lexicon)]]), posterior, np.r_[0.1, np.full(width - 1, 0.3), np.full(len(lexicon), 3.0)])
    return Model(lexicon, weights, rates, shared)


def mining(row_id: Column) -> Column:
    """Which half of the sample a row is in: those that mine voters don't judge them."""
    return F.pmod(F.xxhash64(row_id.cast("string"), F.lit("half")), F.lit(2)) == 0


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, mark, mined) of at most ``sample`` labelled rows outside the held-out third, chosen by a hash of their id."""
    picked = (
        labels.select(labels["doc_id"].alias("id"), labels["toxic"].cast("int").alias("mark"))
        .where("id is not null and mark is not null and crc32(encode(cast(id as string), 'UTF-8')) % 3 <> 1")
        .groupBy("id").agg(F.max("mark").alias("mark"))
    )
    picked = drawn(picked, "id", sample)  # of bounded size, hence sent to every worker
    rows = docs.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("mark").alias("mark"))
    return written(rows.select("id", F.coalesce("text", F.lit("")).alias("text"), "mark", mining(F.col("id")).alias("mined")).repartition(8, "id"))


def mined_voters(rows: DataFrame) -> list[str]:
    """Words and beginnings that speak for class 1 among the mining rows: in four of five rows or more that hold them, and not by chance."""

    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((x, mark) for x in {x for w in set(TOKEN.findall(text.lower())) for x in names(w)})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["name", "mark", "n"])

    n, bad = rows.where("mined").agg(F.count("mark"), F.coalesce(F.sum("mark"), F.lit(0))).first()
    if not 0 < bad < n:
        return []
    each = rows.where("mined").select("text", "mark").mapInArrow(run, "name string, mark int, n long")
    held = each.groupBy("name").agg(F.sum(F.col("n") * F.col("mark")).alias("bad"), F.sum("n").alias("all")).where("bad >= 3 and bad >= 0.8 * all").collect()
    base, out = bad / n, []
    for c, b, every in held:
        good = every - b
        gain = 2 * (b * math.log(b / every / base) + (good * math.log(good / every / (1 - base)) if good else 0))
        if gain > GAIN:
            out.append((-gain, c))
    return [c for _, c in sorted(out)]


def trained(docs: DataFrame, labels: DataFrame, sample: int) -> Model:
    """The model of a table (id, text)."""
    rows = sampled(docs, labels, sample)
    lexicon = {c: k for k, c in enumerate(dict.fromkeys([*WORDS, *mined_voters(rows)]))}
    model = Model(lexicon, np.zeros(0), np.zeros(0), np.zeros(0))

    def run(batches):
        for batch in batches:
            out = []
            for text, mark, mined in zip(*(c.to_pylist() for c in batch.columns)):
                words, patterns = read(text)
                total, each = model.hits(words, {})
                out.append((sorted(each), min(total, 1 << 30), patterns, sum(words.values()), mark, mined))
            if out:
                kinds = [pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["voters", "total", "patterns", "words", "mark", "mined"])

    found = rows.select("text", "mark", "mined").mapInArrow(run, "voters array<int>, total int, patterns array<int>, words int, mark int, mined boolean").collect()
    dropped(rows)
    return fit([Row(*r) for r in sorted(map(tuple, found))], lexicon)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 6000, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1) and predicted (score >= threshold).

    The fit reads labelled rows whose crc32(id as text) mod 3 is not 1: ``sample``
    of them at most, chosen by a hash of the id. Scores see the text alone, all of it; null and empty texts get the score of a text without words. Null ids have a
    null held_out. Repeated rows score alike, an empty table gives no rows, and
    without usable labels the fixed words decide. Other columns are not read.
    """
    spark = docs.sparkSession
    picked = docs.select(docs[id_column].alias("id"), docs[text].alias("text"))
    sent = spark.sparkContext.broadcast(trained(picked, labels, sample))

    def run(batches):
        seen: dict[str, tuple[int, ...]] = {}
        for batch in pieces(batches, "text"):
            scores = [sent.value.score(t or "", seen) for t in batch.column(2).to_pylist()]
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    held = (F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % 3 == 1).alias("held_out")
    return picked.select("id", held, "text").mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_column)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 6000, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; nothing moves.

    Fitted and scored as in :func:`toxicity`, on the whole of every text, however
    long. Null and empty texts stay, repeated rows stay or go together, rows
    without id are judged like others, an empty table gives no rows, and columns
    of any name ride along.
    """
    picked = docs.select(docs[id_column].alias("id"), docs[text].alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(trained(picked, labels, sample))

    def run(batches):
        seen: dict[str, tuple[int, ...]] = {}
        for batch in pieces(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([sent.value.score(t or "", seen) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
