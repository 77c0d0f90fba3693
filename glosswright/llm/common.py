"""Shared pieces: the shared work folder, cut lineage, text as bytes, and linked components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; only a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glosswright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/glosswright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a written table: computed once, and without lineage to lost executors.

    The shuffle files of this write go with its end; those of anything that df itself reads stay.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop what finished jobs have sent to all tasks
    trim()
    return spark.read.schema(df.schema).parquet(path)


#: What drops the tables that modules keep in a Python worker from one task to the next.
KEPT_BETWEEN_TASKS: list = []


def lean() -> None:
    """Drop what other operators' tasks have left in this Python worker, which may be used again by any task."""
    for drop in KEPT_BETWEEN_TASKS:
        drop()
    trim()


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and hold on to it."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send Python workers `rows` rows or 8 MB at a time, where the session has Spark's defaults: texts are long."""
    for key, default, value in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864", 8 << 20)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") in (default, f"{default}b"):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id that each end of edges (a, b) can reach.

    Alternates large-star and small-star steps, which move every edge towards the smallest neighbour; a
    component of any diameter is a star after a logarithmic number of rounds in practice.  Each round is
    written to the shared folder.  Null ids and loops take no part; without edges the result is empty.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "edges")
        size = now.agg(F.count("*").alias("n"), F.countDistinct("a").alias("k"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        state = (size["n"], size["h"])
        if state == before or not size["n"]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    star = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return star.union(star.select(F.col("component").alias("id"), "component").distinct())
