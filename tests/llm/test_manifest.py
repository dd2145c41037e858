"""The Merkle manifest against trees built in one piece, with ranges of a few rows, and against its SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm.manifest import Subtrees, manifest, offsets

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, part int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(leaves):
    """Root, and for each leaf the digests (left, right) of it in every run on its way."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k in range(len(leaves)):
            run = at[k] // 3 * 3
            steps[k].append(("".join(nodes[run : at[k]]), "".join(nodes[at[k] + 1 : run + 3])))
            at[k] //= 3
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], steps


def cut(row):
    even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
    return (*row[:4], row[4].replace("\n", "")) if even and row[4] is not None else row[:5]


def brute(rows):
    of = {}
    for r in rows:
        of.setdefault(r[1], []).append(r)
    sources = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in of[s]]) for s in sources]
    root, tops = tree([t[0] for t in trees])
    for s, (sub, steps), top in zip(sources, trees, tops):
        for place, (r, own) in enumerate(zip(of[s], steps)):
            value = leaf(cut(r))
            for a, b in own + top:
                value = digest(a, value, b)
            yield r[0], leaf(r), sub, root, digest(*(a + b for a, b in own + top)), value, value == root, place


def some(n, seed):
    rng = random.Random(seed)
    texts = [None, "", "one\ntwo", "déjà\nvu", "x" * 300_000 + "\n", "plain"]
    # "hot" holds half of all rows, others one or two; ids are null, repeated or their own; some rows are equal throughout
    rows = [(rng.choice([None, k, k, k // 3]), rng.choice([None, "", "hot", "hot", "hot", f"é{k % 60}"]), rng.choice([None, "en"]), rng.choice([None, k]), rng.choice(texts), "own", 7) for k in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n, per", [(1, 4), (3, 2), (240, 9), (300, 1000)])
def test_equals_trees_in_one_piece(spark, n, per):
    rows = some(n, n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    made = manifest(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")), per=per)
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "place"]
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, brute(rows)))


def test_empty_and_untouched(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert manifest(docs).collect() == []
    docs = spark.createDataFrame(some(20, 5), SCHEMA)
    assert all(r["verified"] for r in manifest(docs, per=4).collect())


def test_one_row_many_times_spreads_over_ranges(spark):
    rows = [(1, "hot", "en", 4, "same", "", 0)] * 200
    made = manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), per=10).collect()
    assert sorted(map(str, map(tuple, made))) == sorted(map(str, brute(rows)))


def test_a_missing_row_changes_the_root(spark):
    rows = some(60, 9)
    roots = {r["root"] for r in manifest(spark.createDataFrame(rows, SCHEMA), per=8).collect()}
    fewer = {r["root"] for r in manifest(spark.createDataFrame(rows[1:], SCHEMA), per=8).collect()}
    assert len(roots) == len(fewer) == 1 and roots != fewer


def test_stretches_hold_every_node_of_theirs():
    leaves = [digest(str(k)) for k in range(40)]
    whole = Subtrees(leaves, 0, 40)
    assert whole.levels[-1][1] == [tree(leaves)[0]] and len(list(whole.ragged())) == 1
    for a, b in ((0, 13), (13, 14), (5, 40), (9, 36), (39, 40)):
        part = Subtrees(leaves[a:b], a, 40)
        covered = [k for lv, i, d, _ in part.ragged() for k in range(3**lv * i, min(3**lv * (i + 1), 40))]
        assert covered and sorted(covered) == list(range(a, b))
        assert all(d == whole.levels[lv][1][i] for lv, i, d, _ in part.ragged())


def test_offsets_chain_over_partitions():
    row = lambda part, first, last, n, m: {"part": part, "first": first, "last": last, "n_first": n, "n_last": m}
    made = offsets([row(0, None, "a", 2, 3), row(1, "a", "a", 5, 5), row(3, "a", "b", 1, 4), row(4, "c", "c", 6, 6)])
    assert made == {0: (0, 2, 9), 1: (3, 9, 9), 3: (8, 9, 4), 4: (0, 6, 6)}
