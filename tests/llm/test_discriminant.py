"""The quality discriminant: statistics against plain Python, sums against numpy, held-out accuracy, edges."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm.discriminant import FIXED, NAMES, Discriminant, Sums, quality, statistics

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string"
SYMBOLS = "#*$%&<>@^~=+_\\/{}[]`"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    w, chars = max(len(words), 1), max(len(re.sub(r"[\x20\x09-\x0D]", "", text)), 1)
    of = lambda test: sum(1 for c in text if test(c))
    share = lambda part, whole: math.log2(1 + 64 * part / whole)
    # by bytes: capitals are A-Z and those of Latin-1, other letters beyond ASCII are small
    upper = lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ"
    lower = lambda c: "a" <= c <= "z" or ord(c) > 127 and not upper(c)
    listed = "0123456789.,;:'\"()-?!|" + SYMBOLS + " \t\n\v\f\r"
    pairs = list(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    whole = [x + "\n" for x in text.split("\n")]
    whole[-1] = whole[-1][:-1]
    used = [x for x in whole if re.search(r"[^\x20\x09-\x0D]", x)]
    caps = [x for x in words if sum(map(upper, x)) >= 2 and not any(map(lower, x))]
    logs = math.log2(1 + len(words))
    row = [
        logs, math.log2(1 + chars / w), share(of(upper), chars), share(of(lambda c: c in "0123456789"), chars), share(of(lambda c: c in ".,;:'\"()-?"), chars), share(text.count("!"), w),
        share(of(lambda c: c in SYMBOLS), w), share(text.count("|"), w), share(of(lambda c: ord(c) < 128 and c not in listed and not upper(c) and not lower(c)), chars), share(sum(a == b for a, b in pairs), w),
        math.log2(1 + len(set(words))) - logs, math.log2(1 + len(set(pairs))) - math.log2(1 + len(pairs)), math.log2(1 + len(lines)) - logs / 2, share(len(used) - len(set(used)), max(len(lines), 1)),
        math.log2(1 + max(map(len, words), default=0)) / 2, share(len(caps), w),
    ]
    return [round(v * FIXED) for v in row]


TEXTS = [None, "", " \n\t ", "word", "The The The cat.\nThe The\n\nThe The\n", "ÄÖ ÄÖ äö!! 12 3|4 %%% $$$", "LOUD WORDS!! AND MORE!!", "a b a b a b c", "日本語 テキスト\n日本語", "x" * 3000, "one\r\ntwo\x0bthree\x0cfour", "tail\n", "\x01\x02 \x7f"]


def test_statistics_by_hand():
    made = statistics(pa.array(TEXTS))
    assert made.shape == (len(TEXTS), len(NAMES))
    for text, row in zip(TEXTS, made.tolist()):
        assert max(abs(a - b) for a, b in zip(row, plain(text))) <= 1, text
    # a text's row doesn't depend on its neighbours
    assert all((statistics(pa.array([t]))[0] == r).all() for t, r in zip(TEXTS, made))
    assert (statistics(pa.array(TEXTS).slice(3, 5)) == made[3:8]).all()


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4000, (90, 3)), rng.integers(1000, 3000, (60, 3))
    low, high = (Sums(len(x), x.sum(0), x.T @ x) for x in (a, b))
    made = Discriminant(low, high, 0.0, 0.0)

    def log_density(x, of):
        m, s = of.mean(0) / FIXED, np.cov(of.T, bias=True) / FIXED**2
        d = x / FIXED - m
        return -0.5 * (d @ np.linalg.inv(s) * d).sum(1) - 0.5 * np.linalg.slogdet(s)[1]

    assert np.allclose(made(a), log_density(a, b) - log_density(a, a)) and made.prior == pytest.approx(math.log(60 / 90))
    assert np.isfinite(Discriminant(low, Sums(5, 5 * np.array([7, 7, 7]), 5 * np.full((3, 3), 49)), 0.0, 0.1)(a)).all()  # a class without spread


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["stone", "river", "light", "garden", "walk", "under", "house", "morning", "paper", "quiet"]
    docs, labels = [], []
    for k in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(30, 120)))
        bad = k % 4 == 0
        if bad:
            text = rng.choice([text.upper() + "!!", text.replace(" ", " %%% "), "again " * 60, text.replace(" ", " | ")])
        docs.append((k, text, "own"))
        labels.append((k, int(not bad)))
    return docs, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs, labels = corpus(600, 3)
    # marks of held-out rows are turned round: they must not matter
    turned = [(i, 1 - m if held_out(i) else m) for i, m in labels]
    rows = quality(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(turned, "doc_id long, quality int")).collect()
    true = dict(labels)
    assert len(rows) == 600 and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == true[r["doc_id"]] for r in rows if r["held_out"]) >= 0.97 * sum(map(held_out, range(600)))


def test_edges(spark):
    docs, labels = corpus(200, 4)
    docs += [(None, docs[1][1], ""), (300, None, ""), (301, "", ""), (302, "long " * 200_000, ""), docs[1], docs[1]]
    labels += [(None, 1), (5, None), (1, 0), (9999, 1)]
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality(frame.repartition(2), marks).collect()
    assert len(rows) == len(docs) and [r["held_out"] for r in rows if r["doc_id"] is None] == [None]
    assert len({r["score"] for r in rows if r["doc_id"] in (1, None)}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (300, 301)}) == 1
    again = quality(frame.repartition(5), marks).collect()  # sums are whole numbers: the order of rows changes nothing
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert quality(frame.limit(0), marks).collect() == []
    assert {r["score"] for r in quality(frame, marks.limit(0)).collect()} == {0.5}


def test_real_rows_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)
