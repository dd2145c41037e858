"""Delivery once: what a batch of a stream has written is recorded beside it, under the batch's number.

A stream that starts again after a failure replays its last batch. A sink that has
its number in the ledger takes it as done; one that failed half-way has left a
folder that no entry names. Entries are made once, so that of two replays at the
same time one counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.log import Log


class Ledger(Log):
    """Rows of numbered batches of one source; ``name`` keeps several sources apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        super().__init__(spark, path)
        self.schema = schema

    def empty(self) -> dict:
        return {"version": 0, "folders": [], "done": {}}

    def write(self, rows: DataFrame, batch: int, name: str = "stream") -> bool:
        """Whether this call delivered the batch; False if it was delivered before. Batches of a source come in order."""
        if self.delivered(self.manifest(), batch, name):
            return False
        folder = f"v-{uuid.uuid4().hex}"
        self.lay(rows, f"{self.path}/{folder}")
        while True:
            head = self.manifest()
            if self.delivered(head, batch, name):  # another replay was first
                self.discard(f"{self.path}/{folder}")
                return False
            state = {"version": head["version"] + 1, "folders": [*head["folders"], folder], "done": head["done"] | {name: batch}}
            if self.add(state, folder):
                return True

    @staticmethod
    def delivered(state: dict, batch: int, name: str) -> bool:
        return batch <= state["done"].get(name, -1)

    def lay(self, rows: DataFrame, folder: str) -> None:
        kinds = self.spark.createDataFrame([], self.schema).schema
        rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in kinds]).write.parquet(folder)

    def read(self) -> DataFrame:
        """All rows delivered so far."""
        paths = [f"{self.path}/{f}" for f in self.manifest()["folders"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def sink(self, stream: DataFrame, checkpoint: str, name: str = "stream", change: Callable[[DataFrame], DataFrame] = lambda rows: rows, every: str | None = None):
        """Starts a query that delivers every batch of ``stream``, after ``change``, once; without an interval it ends when all there is has been read."""
        writer = stream.writeStream.foreachBatch(lambda rows, batch: (self.write(change(rows), batch, name), None)[1]).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def fan_out(ledger: Ledger, updates: DataFrame, subscriptions: DataFrame, checkpoint: str, every: str | None = None):
    """Starts the delivery of a stream of updates to every subscription that they fit."""
    from quarry.streaming.events import delivered

    return ledger.sink(updates, checkpoint, "updates", lambda rows: delivered(rows, subscriptions), every)
