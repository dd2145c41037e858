"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import dropped, written

EDGE = "u long, v long"


class Sets:
    """Union-find over numbered items; the root is the smallest number."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(batches):
    """Stars that connect what the edges of a task connect."""
    sets, seen = Sets(), set()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.join(u, v)
            seen.update((u, v))
    out = [(x, r) for x in seen if (r := sets.root(x)) != x]
    for at in range(0, len(out), 100_000):
        u, v = zip(*out[at : at + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def with_least(edges: DataFrame, pieces: int) -> DataFrame:
    """Adds ``m``, the smallest v among a node's edges, to every edge (u, v).

    A node's edges are dealt to ``pieces`` keys by their other end, so that no
    task holds a hub's edges: minima come up piece by piece, and go back down to
    the pieces that a node has.
    """
    dealt = edges.withColumn("piece", F.pmod(F.xxhash64("v"), F.lit(pieces)).cast("int"))
    partial = dealt.groupBy("u", "piece").agg(F.min("v").alias("low"))
    least = partial.groupBy("u").agg(F.min("low").alias("m"))
    return dealt.join(partial.drop("low").join(least, "u"), ["u", "piece"]).drop("piece")


def components(edges: DataFrame, piece: int = 250_000) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); a component is named by its smallest node.

    Rounds of large-star and small-star, each written to the shared folder, until
    a round changes nothing; stars within tasks first shorten long chains. An
    empty table gives no rows; loops and repeated edges change nothing. piece:
    about how many edges of one node meet in a task (more below 64 times that).
    """
    stars = written(edges.select("u", "v").mapInArrow(forest, EDGE))
    state = None
    while True:
        n, mark = stars.agg(F.count("u"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if not n or (n, mark) == state:
            break
        state, pieces = (n, mark), max(64, -(-n // piece))
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, pieces).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large, pieces).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, stars = stars, written(small.select("e.u", "e.v").where("u <> v").distinct())
        dropped(before)
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
