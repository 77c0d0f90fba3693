"""Sessions: settings for local use, and sending the package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(cores: int | str = "*", memory: str = "8g", **settings: str) -> SparkSession:
    """A local session with the settings that the queries are tested under."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("glosswright")
    defaults = {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"}
    for k, v in (defaults | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_glosswright_sent", False):
        return
    path = Path(tempfile.mkdtemp(prefix="glosswright-")) / "glosswright_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "glosswright").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._glosswright_sent = True


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share; only a local session without spark.checkpoint.dir gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glosswright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/glosswright/{name}-{uuid.uuid4().hex}"
