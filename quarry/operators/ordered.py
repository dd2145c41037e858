"""Work along an order without a window in one task: row numbers, greedy spacing, sliding percentiles.

Rows are sorted by key and order into ranges, which a checkpoint keeps. A partition
is worked through as a stream; what it needs to know of those before it, the rows
or the state at its beginning, is a small table with two rows for each partition.
A key that fills the table is many ranges, keys that fit a range never leave it.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.session import scratch

ROWS, MOST = 1 << 17, 1 << 15  #: rows of a range, and ranges at most; beyond that ranges grow


def ranges(rows: DataFrame, key: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """``rows`` sorted by key and order into ranges that stay as they are from now on, numbered as ``_part``; ties in the order are broken by the row's place."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(rows.sparkSession))
    if parts is None:
        parts = max(1, min(MOST, -(-rows.count() // ROWS)))
    by = [*(F.col(k).asc_nulls_first() for k in key), *order, F.col("_tie").asc()]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    return placed.withColumn("_part", F.spark_partition_id()).checkpoint()


def runs(keys: list) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal neighbours."""
    cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else [0]
    return list(zip(cuts[:-1], cuts[1:]))


def keyed(batch: pa.RecordBatch, at: list[int]) -> list[tuple]:
    return list(zip(*(batch.column(k).to_pylist() for k in at))) if at else [()] * batch.num_rows


def columns(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


# -- row numbers -------------------------------------------------------------


def numbered(rows: DataFrame, order: list[Column], key: list[str] = [], name: str = "number", parts: int | None = None) -> DataFrame:  # noqa: B006
    """``rows`` with their number (from 1) in the order, of all or by key: ``row_number`` without a task that holds a whole key.

    Counts of each range's first and last key go to the driver, two numbers a
    range; with their prefix sums every range numbers its own rows.
    """
    sorted_ = ranges(rows, key, order, parts)
    names = [c for c in sorted_.columns if c != "_part"]
    at = [names.index(k) for k in key]

    def counted(batches):
        found: list = []  # part, first key, last key, rows of the first and of the last
        for batch in batches:
            part, each = batch.column(len(key)), keyed(batch, list(range(len(key))))
            for a, b in runs(each):
                if not found:
                    found = [part[0].as_py(), repr(each[a]), repr(each[a]), 0, 0]
                if repr(each[a]) != found[2]:
                    found[2], found[4] = repr(each[a]), 0
                found[4] += b - a
                if found[1] == found[2]:
                    found[3] += b - a
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in found], ["part", "first", "last", "n_first", "n_last"])

    ends = sorted(sorted_.select(*key, "_part").mapInArrow(counted, "part long, first string, last string, n_first long, n_last long").collect())
    start, before, going = {}, None, 0
    for part, first, last, n_first, n_last in ends:
        start[part] = going if before == first else 0
        going = start[part] + n_first if first == last else n_last
        before = last

    def number(batches):
        last, n = None, None
        for batch in batches:
            each, out = keyed(batch, at), np.empty(batch.num_rows, np.int64)
            if n is None and batch.num_rows:
                last, n = each[0], start[batch.column(len(names))[0].as_py()]
            for a, b in runs(each):
                n = n if each[a] == last else 0
                out[a:b] = np.arange(n + 1, n + 1 + b - a)
                last, n = each[a], n + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out)], [*names, name])

    return sorted_.select(*names, "_part").mapInArrow(number, f"{columns(sorted_, names)}, {name} long")


# -- greedy spacing ----------------------------------------------------------


def successors(at: np.ndarray, gap: int) -> np.ndarray:
    """Of each row the next one that lies ``gap`` or more after it; len(at) where none does."""
    return np.searchsorted(at, at + gap, "left")


def state_map(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, exits): a state that leads to the first entry at or after state + gap leaves as its exit.

    Any state before the stretch enters within one gap of its first row; chains
    are followed by doubling, and entries that leave alike are one.
    """
    n = len(at)
    if not gap:
        return at[:1], at[-1:]
    step = np.minimum(successors(at, gap), n)
    last = np.where(step < n, step, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    few = min(n, int(np.searchsorted(at, at[0] + gap, "left")) + 1)
    exits = at[last[:few]]
    keep = np.r_[exits[1:] != exits[:-1], True]
    return at[:few][keep], exits[keep]


def entered(state: int | None, entries: np.ndarray, exits: np.ndarray, gap: int) -> int:
    if state is None:
        return int(exits[0])
    k = int(np.searchsorted(entries, state + gap, "left"))
    return int(exits[k]) if k < len(entries) else state


def spaced(rows: DataFrame, key: list[str], at: str, gap: int, parts: int | None = None, lead: str | None = None) -> DataFrame:
    """The rows that greedy spacing keeps: the first of each key, then always the next that lies ``gap`` or more after the last one kept.

    at: a column of whole numbers, not null; of equal ones a single row is kept
    (all, if the gap is 0). lead: a column to add, the one kept before (null for
    the first). The order of one key may be cut anywhere: each range states what it makes of
    any state before it, these maps are composed by key in order, and then each
    range knows where it begins.
    """
    if gap < 0:
        raise ValueError("gap is negative")
    sorted_ = ranges(rows, key, [F.col(at).asc()], parts)
    names = [c for c in sorted_.columns if c != "_part"]
    place, keys_at = names.index(at), [names.index(k) for k in key]
    whole = [*names, "_part"]

    def stretches(batches):
        """(is first of the partition, batches of one key)."""
        held, last, first = [], None, True
        for batch in batches:
            each = keyed(batch, keys_at)
            for a, b in runs(each):
                if held and each[a] != last:
                    yield first, False, held
                    held, first = [], False
                last = each[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield first, True, held

    def mapped(batches):
        for first, end, held in stretches(batches):
            if first or end:
                t = pa.Table.from_batches(held)
                entries, exits = state_map(t.column(place).to_numpy().astype(np.int64), gap)
                row = [pa.array([repr(keyed(held[0].slice(0, 1), keys_at)[0])]), pa.array([t.column(len(names))[0].as_py()], pa.int32()), pa.array([first]), pa.array([entries.tolist()], pa.list_(pa.int64())), pa.array([exits.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, ["key", "part", "first", "entries", "exits"])

    maps = sorted_.select(*whole).mapInArrow(mapped, "key string, part int, first boolean, entries array<long>, exits array<long>")

    def composed(batches):
        key_, state = None, None
        for batch in batches:
            for k, part, first, entries, exits in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key_:
                    key_, state = k, None
                if first and state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state], pa.int64())], ["part", "state"])
                state = entered(state, np.array(entries), np.array(exits), gap)

    folded = maps.repartition("key").sortWithinPartitions("key", "part").mapInArrow(composed, "part int, state long")
    begin = {r["part"]: r["state"] for r in folded.collect()}  # a number for each range

    def kept(batches):
        for first, _, held in stretches(batches):
            t = pa.Table.from_batches(held).combine_chunks()
            x = t.column(place).to_numpy().astype(np.int64)
            state = begin.get(t.column(len(names))[0].as_py()) if first else None
            step, chosen = successors(x, gap), []
            k = 0 if state is None else int(np.searchsorted(x, state + gap, "left"))
            while k < len(x):
                chosen.append(k)
                k = int(step[k]) if gap else k + 1
            if chosen:
                out = t.select(names).take(pa.array(chosen))
                if lead:
                    out = out.append_column(lead, pa.array([state, *x[chosen[:-1]].tolist()], pa.int64()))
                yield from out.to_batches()

    return sorted_.select(*whole).mapInArrow(kept, columns(sorted_, names) + (f", {lead} long" if lead else ""))


# -- sliding percentiles -----------------------------------------------------


def sliding(rows: DataFrame, order: list[Column], value: str, shares: dict[str, float], key: list[str] = [], window: int = 1000, block: int = 1 << 14, parts: int | None = None) -> DataFrame:  # noqa: B006
    """``rows`` with percentiles (nearest rank) of the last ``window`` values up to each row, by key.

    Rows are numbered, and cut into blocks that also get the ``window`` - 1 rows
    before them. A task carries one sorted list along a block, so that memory
    is a block and a window. Null values take no part; before the first value the percentiles are null.
    """
    if window < 1:
        raise ValueError("window must be 1 at least")
    block = max(block, window)
    each = numbered(rows, order, key, "_n", parts)
    names = [c for c in each.columns if c != "_n"]
    own = F.floor((F.col("_n") - 1) / block).cast("long")
    also = F.when(F.pmod(F.col("_n") - 1, F.lit(block)) >= block - window + 1, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = each.withColumn("_own", own).withColumn("_block", F.explode(also))

    def step(t: pa.Table) -> pa.Table:
        t = t.sort_by("_n")
        b, own_, values = t.column("_block")[0].as_py(), t.column("_own").to_pylist(), t.column(value).to_pylist()
        held: list = []
        out = {n: [] for n in shares}
        mine = []
        for k, v in enumerate(values):
            if k >= window and values[k - window] is not None:
                del held[bisect_left(held, values[k - window])]
            if v is not None:
                insort(held, v)
            if own_[k] == b:
                mine.append(k)
                for n, s in shares.items():
                    out[n].append(float(held[int(np.floor(s * (len(held) - 1) + 0.5))]) if held else None)
        kept = t.select(names).take(pa.array(mine, pa.int64()))
        for n in shares:
            kept = kept.append_column(n, pa.array(out[n], pa.float64()))
        return kept

    schema = columns(each, names) + "".join(f", {n} double" for n in shares)
    return dealt.groupBy(*key, "_block").applyInArrow(step, schema)
