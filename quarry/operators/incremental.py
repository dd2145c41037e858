"""Incremental loads: what changed between two states of a file set, and how a table follows.

These are the computations; :mod:`quarry.sources.store` keeps tables and commits changes of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

ACTIONS = ("skip", "update", "add", "delete")


@dataclass(frozen=True)
class LoadFlags:
    resume: bool = False
    update: bool = False
    cleanup: bool = False
    dry_run: bool = False
    force: bool = False

    def __post_init__(self):
        if self.force and (self.resume or self.update):
            raise ValueError("force goes with neither resume nor update")

    @property
    def mode(self) -> str:
        """What a load does with files it knows; resuming skips unchanged ones, as any load but a forced one does."""
        return "force" if self.force else "resume" if self.resume else "update" if self.update else "full"


def compared(current: DataFrame, existing: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """(key, action, current and existing mark) of every path in either state."""
    a = current.select(F.col(key), F.col(mark).alias("current"))
    b = existing.select(F.col(key), F.col(mark).alias("existing")).dropDuplicates([key])
    action = F.when(F.col("existing").isNull(), "add").when(F.col("current").isNull(), "delete").when(F.col("current") == F.col("existing"), "skip").otherwise("update")
    return a.join(b, key, "full_outer").withColumn("action", action)


def counted(changes: DataFrame) -> DataFrame:
    """One row: how many paths each action takes."""
    return changes.agg(*[F.coalesce(F.sum((F.col("action") == a).cast("long")), F.lit(0)).alias(a) for a in ACTIONS])


def planned(changes: DataFrame, flags: LoadFlags) -> DataFrame:
    """The changes that a load makes: additions always, updates and deletions on their flags, none in a dry run."""
    if flags.dry_run:
        return changes.where("false")
    if flags.force:
        return changes.where("action <> 'delete'").withColumn("action", F.when(F.col("action") == "skip", "update").otherwise(F.col("action")))
    wanted = ["add"] + ["update"] * flags.update + ["delete"] * flags.cleanup
    return changes.where(F.col("action").isin(wanted))


def applied(store: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """The store after a plan: rows of changed paths go, fresh rows of added and updated ones come."""
    touched = changes.where("action <> 'skip'").select(key)
    coming = fresh.join(changes.where("action in ('add', 'update')").select(key), key, "left_semi")
    return store.join(touched, key, "left_anti").unionByName(coming, allowMissingColumns=True)


def deleted(store: DataFrame, paths: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """What stays, and (key, rows) of what went."""
    return store.join(paths, key, "left_anti"), store.join(paths, key, "left_semi").groupBy(key).agg(F.count("*").alias("rows"))


def known_hashes(store: DataFrame, key: str = "file_path", mark: str = "file_hash") -> DataFrame:
    return store.where(F.col(mark).isNotNull()).select(key, mark).distinct()


def violations(chunks: DataFrame) -> DataFrame:
    """Rows that break a chunk table's rules: (rule, file_path, chunk_index)."""
    rules = {"chunk_index": "chunk_index >= 0", "total_chunks": "total_chunks > 0", "sentences": "start_sentence <= end_sentence", "counts": "word_count >= 0 and char_count >= 0"}
    broken = F.explode(F.filter(F.array(*[F.when(~F.expr(r), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull()))
    single = chunks.select(broken.alias("rule"), "file_path", "chunk_index")
    double = chunks.groupBy("file_path", "chunk_index").count().where("count > 1").select(F.lit("unique").alias("rule"), "file_path", "chunk_index")
    return single.unionByName(double)
