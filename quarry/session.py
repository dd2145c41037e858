"""Session settings of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.parquet.filterPushdown": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def session(name: str = "quarry", **more: str) -> SparkSession:
    """A session with the engine's settings; sizes (memory, shuffle partitions) are the cluster's."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that they need no installation of it."""
    context, home = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_quarry_shipped", False) or not home.is_dir():
        return
    folder = Path(os.path.realpath(tempfile.mkdtemp()))
    with zipfile.ZipFile(folder / "quarry.zip", "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(str(folder / "quarry.zip"))
    context._quarry_shipped = True


def scratch(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share; a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
