"""A table keyed by file in versioned folders, whose states are numbered entries of a log.

Rows lie in buckets of their key. A commit writes the touched buckets to a new
folder and then adds the next entry to ``_log``: a small JSON file that says in
which folder each bucket lies and which buckets it touched. An entry is made only
if no other has its number, so of several writers one gets it. The others look at
what came between: if none of it touched their buckets, their commit moves on top
of it, else it is refused and nothing has changed. Readers see one entry's state,
the newest or an older one that a vacuum has left.

``manifest.json`` is a copy of the newest entry, written after it. An entry that it
knows and the log doesn't is a lost one, and an error, as are folders of finished
commits without any entry.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.sources.log import LOG, Log

ROWS = 8192  #: rows of a task that writes a bucket; a key's rows stay together


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since this commit began."""


@dataclass(frozen=True)
class Committed:
    """What a commit did; without touched buckets it made no version."""

    version: int
    added: int = 0
    deleted: int = 0


class Store(Log):
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "file_path", order: Sequence[str] = (), buckets: int = 64):
        super().__init__(spark, path)
        self.schema, self.key, self.order, self.buckets = schema, key, list(order), buckets

    def empty(self) -> dict:
        return {"version": 0, "buckets": self.buckets, "folders": {}, "touched": []}

    def read(self, only: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The store's rows, or those of some buckets, now or at a version; a missing part of it fails the read."""
        return self._rows(self.manifest(version), only)

    def _rows(self, state: dict, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}/bucket={b}" for b, f in state["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def rows_of(self, key: str) -> DataFrame:
        """The rows of one key in their order; only its bucket is read."""
        known = self.manifest()
        b = self.spark.range(1).select(self.bucket(F.lit(key), known["buckets"])).first()[0]
        return self._rows(known, [b]).where(F.col(self.key) == key).orderBy(*self.order)

    # -- commits -------------------------------------------------------------

    def replace(self, fresh: DataFrame, removed: DataFrame | None = None, base: dict | None = None, stable: bool = False) -> Committed:
        """Commits: rows of every key in ``fresh`` or ``removed`` (column key) go, ``fresh`` comes.

        base: the manifest that the change was decided on, by default the newest;
        a later change of the same buckets by another writer raises Conflict.
        stable: ``fresh`` is a table as it is, and needn't be staged.
        """
        known = self.manifest() if base is None else base
        n = known["buckets"]
        folder = f"v-{uuid.uuid4().hex}"
        kinds = self.spark.createDataFrame([], self.schema).schema
        names = kinds.names
        fresh = fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])
        staged = f"{self.path}/_staged-{folder}"
        try:
            if not stable:
                fresh.write.parquet(staged)  # computed once, whatever models or clocks it asks
                fresh = self.spark.read.schema(fresh.schema).parquet(staged)
            gone = fresh.select(self.key)
            gone = (gone if removed is None else gone.unionByName(removed.select(self.key))).distinct()
            touched = sorted(r[0] for r in gone.select(self.bucket(F.col(self.key), n).alias("b")).distinct().collect())  # at most n numbers
            if not touched:
                return Committed(known["version"])
            kept = self._rows(known, touched).join(gone, self.key, "left_anti").select(*names)
            # counts of files, which Parquet keeps in their footers
            before, added = self._rows(known, touched).count(), fresh.count()
            pieces = max(1, -(-(before + added) // (len(touched) * ROWS)))  # tasks, and files, of a bucket
            dealt = kept.unionByName(fresh).withColumn("bucket", self.bucket(F.col(self.key), n)).withColumn("_piece", F.pmod(F.xxhash64(F.lit("piece"), self.key), F.lit(pieces)))
            laid = dealt.repartition(min(n * pieces, 1 << 15), "bucket", "_piece").drop("_piece").sortWithinPartitions("bucket", self.key, *self.order)
            laid.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/{folder}")
            mine = {b: folder for b in touched if self._fs.exists(self._path(f"{self.path}/{folder}/bucket={b}"))}
            state = {"buckets": n, "folders": {str(b): f for b, f in mine.items()}}
            after = self._rows(state).count()
        finally:
            self._fs.delete(self._path(staged), True)
        version = self._commit(known, touched, mine, folder)
        return Committed(version, added, before - (after - added))

    def _commit(self, base: dict, touched: list[int], mine: dict[int, str], folder: str) -> int:
        seen = base
        while True:
            head = self.manifest()
            for v in range(seen["version"] + 1, head["version"] + 1):
                if set(self.manifest(v)["touched"]) & set(touched):
                    self._fs.delete(self._path(f"{self.path}/{folder}"), True)
                    raise Conflict(f"{self.path}: version {v} changed the same buckets as a commit on version {base['version']}")
            seen = head
            folders = {b: f for b, f in head["folders"].items() if int(b) not in touched} | {str(b): f for b, f in mine.items()}
            state = {"version": head["version"] + 1, "buckets": base["buckets"], "folders": folders, "touched": touched}
            if self.add(state, folder):
                return state["version"]

    def delete(self, keys: DataFrame) -> int:
        """Removes all rows of the keys (column key); how many there were."""
        return self.replace(self.spark.createDataFrame([], self.schema), keys).deleted

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what the ``keep`` newest versions don't name; only while nothing writes or reads an older state. Returns how many folders."""
        known = self.versions()
        self.manifest()  # a lost entry is an error before anything is deleted
        used = {(f, b) for v in known[-keep:] for b, f in self.manifest(v)["folders"].items()}
        old = []
        for name in self._names(self.path):
            if name.startswith("v-") and any(f == name for f, _ in used):
                parts = [n for n in self._names(f"{self.path}/{name}") if n.startswith("bucket=")]
                old += [f"{self.path}/{name}/{n}" for n in parts if (name, n.split("=")[1]) not in used]
            elif name.startswith(("v-", "_")) and name != LOG:
                old.append(f"{self.path}/{name}")
        for p in old:
            self._fs.delete(self._path(p), True)
        self.forget(known[:-keep])
        return len(old)
