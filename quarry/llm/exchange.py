"""Distinct texts in groups, and how often their fingerprints occur over all groups.

Both the suffix and the n-gram operator ask of billions of 64-bit fingerprints
only how often each occurs. A row for each would drown in its own overhead, so
fingerprints travel as packed arrays: a group of texts (a few MB, one row of a
table) sends each bucket of the fingerprint space one array of its distinct
fingerprints with their counts, a task adds up a bucket, and answers every
array with one byte per fingerprint in the same order. A fingerprint that
fills the corpus reaches its bucket once per group at most.

The groups are a table bucketed by group, so that answers join it without
moving a text again. It is written once; retried tasks read the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.common import release, trimmed

#: Bytes of a group, of a bucket of the groups' table, of a bucket of fingerprints; bytes of a task's texts while there are few, and most tasks.
GROUP, BUCKET, SLICE, PART, PARTS = 4 << 20, 48 << 20, 16 << 20, 16 << 20, 32_768
BUCKETS = 8192  #: so that a group sends a bounded number of arrays
MOST = (1 << 20) - 1  #: texts of a group, so that grp << 20 numbers them (32768 tasks, 2^24 groups a task: below 2^59)
NO_ID = -(1 << 63)
ANSWERS = "grp long, bucket int, answer binary"


def key_of(text: Column) -> Column:
    """The key of a text: its SHA-256."""
    return F.unhex(F.sha2(text, 256))


@dataclass
class Groups:
    """A table of group rows: grp, ends, keys, first ids, copies, and the texts' bytes end to end."""

    spark: SparkSession
    name: str
    n_bytes: int

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def __enter__(self) -> Groups:
        return self

    def __exit__(self, *error) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        release(self.spark)


@dataclass
class Group:
    number: int
    ends: np.ndarray
    keys: list[bytes]
    first: np.ndarray
    copies: np.ndarray
    raw: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.r_[0, self.ends[:-1]].astype(np.int64)


FIELDS = ["grp", "ends", "keys", "first", "copies", "raw"]


def opened(batch: pa.RecordBatch):
    """Group rows of a batch, one after the other."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in FIELDS]
    for k in range(batch.num_rows):
        grp, ends, keys, first, copies, raw = (c[k] for c in columns)
        keys = keys.as_py()
        yield Group(grp.as_py(), np.frombuffer(ends.as_py(), "<i8"), [keys[i : i + 32] for i in range(0, len(keys), 32)], np.frombuffer(first.as_py(), "<i8"), np.frombuffer(copies.as_py(), "<i8"), np.frombuffer(raw.as_buffer(), np.uint8))


def grouped(docs: DataFrame, least: int) -> Groups:
    """Groups of the distinct texts of ``docs`` (columns id and text) that have ``least`` bytes or more."""
    spark = docs.sparkSession
    docs = docs.where(F.octet_length("text") >= least).select(key_of(F.col("text")).alias("key"), F.col("id").cast("long").alias("id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fields = ["key", "id", "n", "text"]

    def once(batches):
        """A text leaves the task once; its other copies follow as counts."""
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            take = []
            ids = batch.column(1).to_pylist()
            for k, key in enumerate(batch.column(0).to_pylist()):
                i = NO_ID if ids[k] is None else ids[k]
                if key in seen:
                    of = seen[key]
                    of[0] += 1
                    of[1] = i if of[1] == NO_ID else of[1] if i == NO_ID else min(i, of[1])
                else:
                    seen[key] = [0, NO_ID]
                    take.append(k)
            if take:
                t = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array([NO_ID if ids[k] is None else ids[k] for k in take], pa.int64()), pa.array([1] * len(take), pa.int64()), t.column(2)], fields)
        more = [(k, i, n) for k, (n, i) in seen.items() if n]
        for at in range(0, len(more), 10_000):
            k, i, n = zip(*more[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(k), pa.string())], fields)

    def pack(batches):
        """Groups of texts as their rows come, equal keys next to each other; one group is held at a time."""
        number = TaskContext.get().partitionId() << 24
        part: list[list] = []
        size = 0

        def row():
            keys, ids, copies, raws = zip(*part)
            values = [number, np.cumsum([len(r) for r in raws]).astype("<i8").tobytes(), b"".join(keys), np.array(ids, "<i8").tobytes(), np.array(copies, "<i8").tobytes(), b"".join(raws)]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(values)], FIELDS)

        for batch in batches:
            for key, i, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.large_binary())):
                if part and part[-1][0] == key:
                    of = part[-1]
                    of[1] = i if of[1] == NO_ID else of[1] if i == NO_ID else min(i, of[1])
                    of[2] += n
                    continue
                if size >= GROUP or len(part) == MOST:
                    yield row()
                    part, size, number = [], 0, number + 1
                part.append([key, i, n, text.as_buffer().to_pybytes()])  # of equal keys a row with the text comes first
                size += len(part[-1][3])
        if part:
            yield row()

    distinct = docs.mapInArrow(trimmed(once), "key binary, id long, n long, text string")
    dealt = distinct.repartition(max(1, -(-total // max(PART, total // PARTS))), "key")
    rows = dealt.sortWithinPartitions("key", F.col("text").isNull()).mapInArrow(trimmed(pack), "grp long, ends binary, keys binary, first binary, copies binary, raw binary")
    name = f"quarry_{uuid.uuid4().hex}"
    try:
        rows.write.option("compression", "zstd").bucketBy(max(1, min(8192, -(-total // BUCKET))), "grp").sortBy("grp").saveAsTable(name)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        raise
    del rows, dealt, distinct
    release(spark)
    return Groups(spark, name, total)


def bucket_of(prints: np.ndarray, buckets: int) -> np.ndarray:
    return ((prints * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets


def parcels(group: int, prints: np.ndarray, counts: np.ndarray, buckets: int):
    """Rows (bucket, grp, prints, counts) of a group's distinct fingerprints."""
    bucket = bucket_of(prints, buckets)
    order = np.argsort(bucket, kind="stable")
    prints, counts, bucket = prints[order], np.minimum(counts[order], 255).astype(np.uint8), bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(bucket)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts].astype(np.int32)), pa.array(np.full(len(cuts), group, np.int64)),
            pa.array([prints[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        ],
        ["bucket", "grp", "prints", "counts"],
    )


def added(t: pa.Table) -> pa.Table:
    """Answers of one bucket: the total of each fingerprint, 255 at most."""
    sent = t.column("prints").to_pylist()
    prints = np.frombuffer(b"".join(sent), np.uint64)
    counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8)
    order = np.argsort(prints)
    ranked = prints[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])  # neighbours in order that are equal
    sums = np.minimum(np.add.reduceat(counts[order].astype(np.int64), first), 255)
    answer = np.empty(len(prints), np.uint8)
    answer[order] = np.repeat(sums, np.diff(np.r_[first, len(ranked)])).astype(np.uint8)
    ends = np.cumsum([len(p) // 8 for p in sent])
    return pa.table([t.column("grp"), t.column("bucket"), pa.array([answer[b - len(p) // 8 : b].tobytes() for b, p in zip(ends, sent)], pa.binary())], ["grp", "bucket", "answer"])


def answered(sent: DataFrame) -> DataFrame:
    """One row per group: its answers by bucket."""
    answers = sent.groupBy("bucket").applyInArrow(added, ANSWERS)
    return answers.groupBy("grp").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))


def totals(prints: np.ndarray, answers: list[dict], buckets: int) -> np.ndarray:
    """Totals of a group's distinct fingerprints, in their order."""
    bucket = bucket_of(prints, buckets)
    order = np.argsort(bucket, kind="stable")
    out = np.zeros(len(prints), np.uint8)
    if answers:
        out[order] = np.frombuffer(b"".join(a["answer"] for a in sorted(answers, key=lambda a: a["bucket"])), np.uint8)
    return out


def send(groups: DataFrame, make: Callable, buckets: int) -> DataFrame:
    """make(group, batch row) -> distinct fingerprints and counts."""

    def run(batches):
        for batch in batches:
            for k, g in enumerate(opened(batch)):
                yield parcels(g.number, *make(g, batch, k), buckets)

    return groups.mapInArrow(trimmed(run), "bucket int, grp long, prints binary, counts binary")


def slices(n_bytes: int, per_byte: float) -> int:
    """Buckets for about so many bytes of fingerprints per byte of text; from BUCKETS on they grow instead of their number."""
    return max(1, min(BUCKETS, int(-(-n_bytes * per_byte // SLICE))))
