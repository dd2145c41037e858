"""Removal of repeated passages: difference-cover samples first, then the prefixes of what they leave open.

The question is which 200-byte prefixes of suffixes occur twice, so suffixes
need no order beyond that depth. Of the difference-cover algorithm stand:

1. *Sampled triples.* A perfect difference set modulo 133 (12 residues) gives the
   sample positions of each text. For any two suffixes there is a shift below
   133 at which both meet a sample position. A sampled suffix's triple is three
   blocks of 22 bytes, and 132 + 66 <= 200: the common prefix of two suffixes in
   question holds a triple that both sampled.
2. *Names.* Equal triples get equal names. A suffix whose samples within reach
   all have names of their own repeats nothing and leaves.
3. *The remaining suffixes* get names of their first 200 bytes.
4. *Equal names next to each other* within a sorted bucket are repeats.

Departures, for the disk that ranking takes (figures in the README): names are
not ranks but polynomials modulo 2^61 - 1 at a base drawn for the job, sorted in
buckets rather than over the whole corpus; nothing recurses, as a next level's
names would reach past the depth; and the prefixes' bytes themselves don't move,
so that two of n remaining suffixes that differ are taken for equal with a
chance of n^2 * 200 / 2^62 at most. Equal texts are one row; texts beyond their
first copy are repeats as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import written
from quarry.llm.exchange import Group, Groups, answered, grouped, key_of, opened, send, slices, totals

#: A perfect difference set modulo 133.
COVER, MODULUS = [1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110], 133
BLOCK = 22


PRIME = (1 << 61) - 1
SPAN = 1 << 20  #: bytes that are summed up at once


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it: halves of 31 bits, and 2^61 counts as 1."""
    half, mask = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & mask, b >> half, b & mask
    middle = a1 * b0 + a0 * b1
    x = (a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0
    return reduced(x)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


@functools.lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo PRIME."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, product(out, np.uint64(pow(base, len(out), PRIME)))])
    return out[:n]


def prints(raw: np.ndarray, place: np.ndarray, length: int, base: int) -> np.ndarray:
    """The strings of ``length`` bytes at ascending places as polynomials of ``base`` modulo PRIME.

    base is drawn anew for each job, so no input can be made to collide: two
    different strings share a print with a chance of length / 2^61 at most.
    Work goes span by span, so memory beyond the result doesn't grow with a text.
    """
    size = SPAN + length
    up, down = powers(base, size), powers(pow(base, -1, PRIME), SPAN)
    high, low = up >> np.uint64(32), up & np.uint64(0xFFFFFFFF)
    out = np.empty(len(place), np.uint64)
    for at in range(0, len(raw), SPAN):
        i, j = np.searchsorted(place, [at, at + SPAN])
        if i == j:
            continue
        byte = raw[at : at + size].astype(np.uint64) + np.uint64(1)
        here = place[i:j] - at
        parts = []
        for half in (high, low):  # sums of a span stay below 2^62
            sums = np.zeros(len(byte) + 1, np.uint64)
            np.cumsum(byte * half[: len(byte)], out=sums[1:])
            parts.append(sums[here + length] - sums[here])
        top, bottom = parts
        value = reduced((top >> np.uint64(29)) + ((top & np.uint64((1 << 29) - 1)) << np.uint64(32)) + bottom)
        out[i:j] = product(value, down[here])
    return out


def sampled(g: Group) -> np.ndarray:
    """Sample positions whose triple fits into their text."""
    out = []
    residues = np.array(COVER)
    for a, b in zip(g.starts.tolist(), g.ends.tolist()):
        rows = np.arange(0, b - a, MODULUS)[:, None] + residues
        rows = rows.ravel()
        out.append(a + rows[rows + 3 * BLOCK <= b - a])
    return np.concatenate(out)


def triples(g: Group, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample positions and the names of their triples."""
    place = sampled(g)
    return place, prints(g.raw, place, 3 * BLOCK, base)


def named(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unique, back, counts = np.unique(prints, return_inverse=True, return_counts=True)
    return unique, back, counts


def remaining(g: Group, answers: list[dict], buckets: int, depth: int, base: int) -> np.ndarray:
    """Suffixes that reach an unsettled sample within the cover's modulus and have ``depth`` bytes."""
    place, names = triples(g, base)
    unique, back, _ = named(names)
    held = place[totals(unique, answers, buckets)[back] > 1]
    text = np.searchsorted(g.ends, held, "right")
    from_ = np.maximum(held - (MODULUS - 1), g.starts[text])
    to = np.minimum(held, g.ends[text] - depth) + 1
    fits = to > from_
    change = np.zeros(len(g.raw) + 1, np.int32)
    np.add.at(change, from_[fits], 1)
    np.add.at(change, to[fits], -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def runs(covered: np.ndarray) -> np.ndarray:
    """Starts of runs of True."""
    return covered & ~np.r_[False, covered[:-1]]


def repeated_passages(docs: DataFrame, depth: int = 200, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when a string of ``depth`` bytes over it also starts elsewhere in
    the input, in this text or another. Texts are UTF-8 bytes; null counts as
    empty, texts shorter than ``depth`` keep all. Copies of a text, repeated rows
    and null ids among them, all go as a whole if they have ``depth`` bytes. An
    empty table gives no rows; other columns are not read. A text is one row's
    work: memory is about 40 times the longest text, or the group's few MB.
    """
    if depth < MODULUS - 1 + 3 * BLOCK:
        raise ValueError(f"depth must be {MODULUS - 1 + 3 * BLOCK} at least")
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[id_column].alias("id"), body.alias("text"))
    base = random.SystemRandom().randrange(1 << 32, PRIME)
    with grouped(rows.select(F.lit(None).cast("long").alias("id"), "text"), depth) as groups:
        result = removed(groups, depth, base)
    keyed = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), key_of(F.col("text")).alias("key"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return keyed.join(result, "key", "left").select(F.col("id").alias(id_column), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def removed(groups: Groups, depth: int, base: int) -> DataFrame:
    """(key, n_removed, n_spans, kept) of every distinct text that loses something."""
    first = slices(groups.n_bytes, 8 * len(COVER) / MODULUS)
    second = slices(groups.n_bytes, 2.0)

    def sample_names(g: Group, batch, k):
        unique, _, counts = named(triples(g, base)[1])
        return unique, counts

    settled = written(answered(send(groups.table, sample_names, first)))
    joined = groups.table.join(settled, "grp", "left")

    def left_over(g: Group, batch, k):
        """The remaining suffixes, and the names of their prefixes: distinct, by suffix, counts."""
        place = remaining(g, batch.column("answers")[k].as_py() or [], first, depth, base)
        return place, *named(prints(g.raw, place, depth, base))

    def remaining_names(g: Group, batch, k):
        _, unique, _, counts = left_over(g, batch, k)
        return unique, counts

    adjacent = written(answered(send(joined, remaining_names, second)).withColumnRenamed("answers", "repeats"))

    def cut(batches):
        for batch in batches:
            for k, g in enumerate(opened(batch)):
                place, unique, back, _ = left_over(g, batch, k)
                start = place[totals(unique, batch.column("repeats")[k].as_py() or [], second)[back] > 1]
                change = np.zeros(len(g.raw) + 1, np.int32)
                np.add.at(change, start, 1)
                np.add.at(change, start + depth, -1)
                covered = np.cumsum(change[:-1]) > 0
                keys, gone, spans, shas = [], [], [], []
                for key, a, b, n in zip(g.keys, g.starts.tolist(), g.ends.tolist(), g.copies.tolist()):
                    over = np.ones(b - a, bool) if n > 1 else covered[a:b]
                    if over.any():
                        keys.append(key)
                        gone.append(int(over.sum()))
                        spans.append(int(runs(over).sum()))
                        shas.append(hashlib.sha256(g.raw[a:b][~over].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], ["key", "n_removed", "n_spans", "kept"])

    return written(joined.join(adjacent, "grp", "left").mapInArrow(cut, "key binary, n_removed long, n_spans long, kept string"))
