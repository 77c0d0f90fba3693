"""Streaming queries over files, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vocabulary as v
from ..session import work_folder
from ..streaming import lines
from .governed_queries import DEFAULT, SUMMARY_SQL, _ids, _vocabulary, physical_sql, prefix

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _answers(spark, rows, verb, policy=DEFAULT):
    """rows (id, subject) as a folder of JSON lines, through a verb, read back."""
    at = work_folder(spark, "stream")
    rows.select(F.to_json(F.struct(F.col("subject").alias("identifier"), "id"))).write.text(f"{at}/in")
    lines.run(lines.read_lines(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint", _vocabulary(spark), policy, verb).awaitTermination()
    return spark.read.schema("line long, id string, input string, ok boolean, result string, error string, error_type string").json(f"{at}/out")


def _names(spark, sf):
    return _ids(spark, sf).withColumnRenamed("identifier", "subject")


@query(f"{prefix()} SELECT id, logical_name FROM expanded")
def governed_stream(spark, sf):
    """Names as a stream of lines through the expanding verb."""
    return _answers(spark, _names(spark, sf), "expand").select(F.col("id").cast("long").alias("id"), F.get_json_object("result", "$.logical_name").alias("logical_name"))


@query(physical_sql(DEFAULT, "SELECT id, logical_name AS logical FROM expanded", True) + " SELECT id, physical FROM phys")
def stream_physical(spark, sf):
    from ..operators import governed as g

    logical = g.expand_identifiers(_ids(spark, sf), _vocabulary(spark), DEFAULT).select("id", F.col("logical_name").alias("subject"))
    return _answers(spark, logical, "physical").select(F.col("id").cast("long").alias("id"), F.get_json_object("result", "$.physical").alias("physical"))


@query(f"{prefix()} {SUMMARY_SQL}")
def stream_check(spark, sf):
    rows = _answers(spark, _names(spark, sf), "check")
    found = F.from_json("result", "compliant boolean, findings array<struct<verdict:string>>")
    rows = rows.select(F.col("id").cast("long").alias("id"), found.alias("r"))
    return rows.select("id", "r.compliant", F.size("r.findings").cast("long").alias("n_findings"), F.size(F.filter("r.findings", lambda f: f["verdict"] == "fail")).cast("long").alias("n_failures"))


@query(f"{prefix()} SELECT id, coalesce(fixed, '') AS normalized FROM nm")
def stream_normalize(spark, sf):
    return _answers(spark, _names(spark, sf), "normalize").select(F.col("id").cast("long").alias("id"), F.get_json_object("result", "$.normalized").alias("normalized"))


@query(f"{prefix()}, u AS (SELECT id, string_agg(up, ' ' ORDER BY pos) AS unknown FROM et WHERE NOT is_known GROUP BY id) SELECT e.id, e.fully_known, coalesce(u.unknown, '') AS unknown FROM expanded e LEFT JOIN u ON u.id = e.id")
def stream_audit(spark, sf):
    rows = _answers(spark, _names(spark, sf), "audit")
    found = F.from_json("result", "is_fully_known boolean, unknown_tokens array<string>")
    return rows.select(F.col("id").cast("long").alias("id"), found.alias("r")).select("id", F.col("r.is_fully_known").alias("fully_known"), F.array_join("r.unknown_tokens", " ").alias("unknown"))


@query(f"{prefix()}, u AS (SELECT id, first(token ORDER BY pos) AS token FROM et WHERE NOT is_known GROUP BY id) SELECT i.id, u.token IS NULL AS ok, CASE WHEN u.token IS NOT NULL THEN 'unknown token ' || u.token END AS error, CASE WHEN u.token IS NOT NULL THEN 'LexiconError' END AS error_type FROM ids i LEFT JOIN u ON u.id = i.id")
def stream_reject(spark, sf):
    rows = _answers(spark, _names(spark, sf), "expand", DEFAULT.but(unknown="reject"))
    return rows.select(F.col("id").cast("long").alias("id"), "ok", "error", "error_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """The windowed count of the events as a stream of files."""
    at = work_folder(spark, "windows")
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    lines.run_windows(events.withColumn("ts", F.col("ts").cast("timestamp")), at, f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long").parquet(f"{at}/windows").withColumn("start", F.col("start").cast("timestamp_ntz"))
