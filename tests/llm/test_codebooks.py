"""Vector codes against the iteration written out with Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quarry.llm.codebooks import Numbers, Round, above, bound_of, coded, integer, squared, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def nearest(x, entries):
    return min(((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(entries)))


def brute(rows, parts=4, rounds=4):
    kept = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    vectors = [[math.floor(1024 * int(c)) if abs(c) > 2**60 else math.floor(1024 * c) for c in r[1]] for r in kept]
    w = len(vectors[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    firsts = {}
    for r, v in zip(kept, vectors):
        if r[0] is not None:
            firsts.setdefault(r[0], v)
    books = [[cut(firsts[i], p) for i in sorted(firsts)[:256]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for v in vectors:
                of.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for v in vectors]
    error = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for r, e in zip(kept, error):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    most = (1 << 63) - 1
    return sorted(str((r[0], r[2], "".join(f"{k:02x}" for _, k in f), min(e, most), min(of_label[r[2]], most), sha)) for r, f, e in zip(kept, found, error))


def made(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA).repartition(3)
    out = vector_codes(df, **kw)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(str(tuple(r)) for r in out.collect())


def some(n, seed, width=8, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 3) for _ in range(width)] for _ in range(5)]
    rows = []
    for k in range(n):
        v = [scale * (c + rng.gauss(0, 0.3)) for c in rng.choice(centres)]
        if k % 3 == 0:
            v = [0.25 * round(c) for c in v]  # equal parts, and ties
        rows.append((k if k % 50 else None, v, rng.choice([None, 0, 1, 1, 1])))
    return rows


def test_equals_the_iteration_written_out(spark):
    rows = some(700, 1)
    rows += rows[5:25]  # repeated rows
    rows += [(9001, None, 1), (9002, [], 1), (9003, [1.0, None] * 4, 1), (9004, [float("nan")] * 8, 2), (9005, [float("inf")] + [0.0] * 7, 2), (9006, [0.0] * 8, None)]
    assert made(spark, rows) == brute(rows)


@pytest.mark.parametrize("scale", [2.0**12, 2.0**22, 1e30, 1e300])
def test_large_numbers(spark, scale):
    rows = some(60, 2, scale=scale)
    assert made(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert made(spark, []) == [] and made(spark, [(1, None, 0)]) == []
    for rows in ([(4, [1.0, 2.0, 3.0, 4.0], None)], [(4, [1.0] * 4, 1)] * 5, [(2, [0.5] * 4, 1), (1, [0.5] * 4, 1), (3, [-0.5] * 4, 1)]):
        assert made(spark, rows) == brute(rows)


def test_other_lengths(spark):
    rows = [(k, [float(k), 1.0, 2.0, float(k % 3)], 0) for k in range(9)]
    assert made(spark, rows + [(50, [1.0] * 8, 0), (51, [1.0], 0)]) == brute(rows)
    filled = [(k, [*v, 0.0, 0.0], l) for k, v, l in ((k, [float(k), 1.0, 5.0 - k, 2.0, 0.5, 7.0], 0) for k in range(7))]
    assert made(spark, [(k, v[:6], l) for k, v, l in filled]) == brute(filled)


def test_bounds_prune_and_keep_ties():
    rng = np.random.default_rng(4)
    centres = rng.integers(-9000, 9000, (32, 4))
    x = centres[rng.integers(0, 32, 4000)] + rng.integers(-60, 60, (4000, 4))
    before, after = centres + 40, centres + 44
    numbers = Numbers(1 << 15, 4)
    first = Round([before] * 4, None, numbers)
    at, upper, lower = first.first(x, 0)
    unit = 2.0 * (1 << 15) * 2
    held = bound_of(unit)[coded(lower, unit)]
    assert (held <= lower).all() and (held >= 0.97 * lower)[lower > unit / 100].all()
    again = Round([after] * 4, [above(squared(after - before))] * 4, numbers)
    new, up, low = again.again(x, 0, at, upper, held)
    squares = numbers.squares(x, after)
    assert (new == squares.argmin(1)).all() and again.compared < squares.size / 4
    assert (np.sqrt(squares[np.arange(len(x)), new]) <= up).all() and (low <= np.sqrt(squares)).all()


def test_integers_are_floors():
    assert [integer(x) for x in (0.0, -0.0001, 1.5, -1.5, 2.0**60, -(2.0**70))] == [0, -1, 1536, -1536, 2**70, -(2**80)]
