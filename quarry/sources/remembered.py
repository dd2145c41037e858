"""What a model has answered, kept by content: equal texts are asked once, over all jobs.

A table keyed by the hash of model and text, in a versioned store. A lookup joins the
texts with the buckets that their keys lie in; what is missing, or older than a limit,
is asked for, each text once, and kept by a commit. Jobs that ask for the same text at
the same time may both ask; the later commit is refused if it touches the same
buckets, and then tried again on what the other one has kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators.chunking import embedded, stable
from quarry.operators.keywords import asked
from quarry.sources.store import Conflict, Store

SCHEMA = "key string, vector array<float>, answer string, kept_at timestamp"
TRIES = 5


class Remembered:
    """Vectors and answers of named models."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, seconds: int | None = None):
        self.spark, self.seconds = spark, seconds
        self.store = Store(spark, path, SCHEMA, "key", (), buckets)

    def _key(self, name: str, text: str):
        return F.sha2(F.concat(F.lit(name), F.lit("\x1f"), F.col(text)), 256)

    def _known(self, keys: DataFrame, base: dict) -> DataFrame:
        """Kept rows of the keys; only their buckets are read."""
        n = base["buckets"]
        wanted = sorted(r[0] for r in keys.select(self.store.bucket(F.col("_key"), n)).distinct().collect())  # numbers of buckets
        held = self.store.read(wanted, base["version"] or None)
        return held if self.seconds is None else held.where(F.col("kept_at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(self.seconds))))

    def _with(self, rows: DataFrame, name: str, text: str, value: str, out: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        keyed = rows.withColumn("_key", F.when(F.col(text).rlike(r"(?U)\S"), self._key(name, text)))
        texts = stable(keyed.where("_key is not null").groupBy("_key").agg(F.first(text).alias("_text")))
        for k in range(TRIES):
            base = self.store.manifest()
            known = self._known(texts, base)
            missing = texts.join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
            kinds = {"vector": "array<float>", "answer": "string"}
            fresh = ask(missing).where(F.col(value).isNotNull())
            fresh = fresh.select(F.col("_key").alias("key"), *[(F.col(c) if c == value else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()], F.current_timestamp().alias("kept_at"))
            try:
                done = self.store.replace(fresh, base=base)
                break
            except Conflict:
                if k == TRIES - 1:
                    raise
        held = self._known(texts, self.store.manifest(done.version) if done.version else base).select(F.col("key").alias("_key"), F.col(value).alias(out))
        return keyed.join(held, "_key", "left").drop("_key")

    def embeddings(self, rows: DataFrame, text: str, name: str, model: Callable[[list[str]], list[list[float]]], size: int, out: str = "embedding") -> DataFrame:
        """``rows`` with the vector of their text; blank texts have none. name: of the model, as vectors of two aren't alike."""
        return self._with(rows, f"{name}/{size}", text, "vector", out, lambda missing: embedded(missing, "_text", model, out="vector", size=size))

    def answers(self, rows: DataFrame, text: str, name: str, model: Callable[[list[str]], list[str]], out: str = "answer", wait: float = 1.0) -> DataFrame:
        """``rows`` with what a text model says to their text; what it failed to answer is not kept, and asked again by the next job."""
        return self._with(rows, name, text, "answer", out, lambda missing: asked(missing, "_text", model, wait=wait))

    def forget(self, seconds: int) -> int:
        """Drops what was kept longer ago; how many entries."""
        old = self.store.read().where(F.col("kept_at") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(seconds))))
        return self.store.delete(old.select("key"))
