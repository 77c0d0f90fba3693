"""Stateless verbs over a stream of lines, and a windowed count of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import governed
from ..operators.vocabulary import Policy, Vocabulary

VERBS = ("expand", "physical", "check", "normalize", "audit")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, split) of a folder of text files, as a stream."""
    return spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def numbered(lines: DataFrame) -> DataFrame:
    """(line, value, file): the number of each line in its file, from 1.  Only the counts of splits are put in order."""
    rows = lines.withColumn("m", F.monotonically_increasing_id())  # rows of a split follow each other in its task
    splits = rows.groupBy("file", "split").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "split", "first", "before")
    return rows.join(splits, ["file", "split"]).select((F.col("m") - F.col("first") + F.col("before") + 1).alias("line"), "value", "file")


def subjects(lines: DataFrame) -> DataFrame:
    """(line, id, input, subject, problem) of (line, value): blank lines are left out.

    A line that begins with a brace is an object with a string `identifier` and maybe an `id`, a string, number
    or boolean that comes back as it is in JSON; any other line is the name itself.
    """
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = lines.withColumn("text", text).where("text <> ''").withColumn("v", F.when(F.col("text").startswith("{"), F.try_parse_json("text")))
    is_json = F.col("text").startswith("{")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.identifier", "variant"))
    id_kind = F.schema_of_variant(F.try_variant_get("v", "$.id", "variant"))
    bad_id = id_kind.rlike("^(OBJECT|ARRAY)")
    problem = (
        F.when(~is_json, None)
        .when(F.col("v").isNull(), "line is not valid JSON")
        .when(bad_id, "'id' must be a string, a number or a boolean")
        .when(kind.isNull() | (kind != "STRING"), "a JSON record must carry a string 'identifier'")
    )
    subject = F.when(~is_json, F.col("text")).otherwise(F.try_variant_get("v", "$.identifier", "string"))
    given = F.when(is_json & ~F.coalesce(bad_id, F.lit(False)), F.try_variant_get("v", "$.id", "variant"))
    rows = rows.select("line", F.to_json(given).alias("id"), "text", F.when(problem.isNull(), subject).alias("subject"), problem.alias("problem"))
    return rows.select("line", F.when(F.col("id") != "null", F.col("id")).alias("id"), F.coalesce("subject", "text").alias("input"), "subject", "problem")


def _answers(names: DataFrame, verb: str, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(subject, result) of distinct (id, subject): the verb's answer in JSON."""
    ids = names.withColumnRenamed("subject", "identifier")
    if verb == "physical":
        found = governed.to_physical(ids.withColumnRenamed("identifier", "logical"), vocabulary, policy).withColumn("identifier", F.col("logical"))
        columns = ["logical", "physical", "confidence", "term_id"]
    elif verb == "expand":
        found, columns = governed.expand_identifiers(ids, vocabulary, policy), ["identifier", "logical_name", "fully_known", "confidence", "class_word", "n_tokens", "unaccounted"]
    elif verb == "check":
        found = governed.judged(ids, vocabulary, policy).withColumn("compliant", ~F.exists("findings", lambda f: f["verdict"] == "fail"))
        columns = ["identifier", "compliant", "findings"]
    elif verb == "normalize":
        found, columns = governed.normalize(ids, vocabulary, policy).withColumn("name", F.col("identifier")), ["name", "normalized"]
    elif verb == "audit":
        found, columns = governed.audit_names(ids, vocabulary, policy), ["identifier", "occurrences", "is_fully_known", "compliant", "unknown_tokens", "codes", "normalized"]
    else:
        raise ValueError(f"unknown verb {verb!r}")
    return found.select(F.col("identifier").alias("subject"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("result"))


def answer(lines: DataFrame, verb: str, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(line, id, input, ok, result, error, error_type) of (line, value): one record for each line that is not blank.

    Distinct names meet the vocabulary once.  What goes wrong with a line is said in its own record; under a
    policy that rejects unknown tokens, names with one are such lines.
    """
    rows = subjects(lines)
    good = rows.where("problem is null").select("subject").distinct().select(F.xxhash64("subject").alias("id"), "subject")
    lenient = policy.but(unknown="passthrough_titlecase") if policy.unknown == "reject" else policy
    found = _answers(good, verb, vocabulary, lenient)
    if policy.unknown == "reject" and verb != "physical":
        tokens = governed.expand_tokens(governed.tokens_of(good.withColumnRenamed("subject", "identifier"), vocabulary), vocabulary, lenient)
        refused = tokens.where("not is_known").groupBy(F.col("identifier").alias("subject")).agg(F.min_by("token", "pos").alias("refused"))
        found = found.join(refused, "subject", "left")
    else:
        found = found.withColumn("refused", F.lit(None).cast("string"))
    rows = rows.join(found, "subject", "left")
    refused = F.col("refused").isNotNull()
    error = F.coalesce("problem", F.when(refused, F.concat(F.lit("unknown token "), "refused")))
    kind = F.when(F.col("problem").isNotNull(), "InputError").when(refused, "LexiconError")
    return rows.select("line", "id", "input", error.isNull().alias("ok"), F.when(error.isNull(), F.col("result")).alias("result"), error.alias("error"), kind.alias("error_type"))


def record(rows: DataFrame) -> DataFrame:
    """(value): compact JSON lines of answer()'s rows; absent ids, results and errors are left out."""

    def part(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))

    def quoted(c: str) -> Column:
        return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1)

    parts = [part("line", F.col("line").cast("string")), part("id", F.col("id")), part("input", quoted("input")), part("ok", F.col("ok").cast("string")), part("result", F.col("result"))]
    parts += [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{c}":'), quoted(c))) for c in ("error", "error_type")]
    return rows.select(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")).alias("value"))


def run(lines: DataFrame, sink: str, checkpoint: str, vocabulary: Vocabulary, policy: Policy, verb: str = "expand"):
    """Process what there is and end.  Each micro-batch is a batch plan, written to a folder of its own, so that one
    that is repeated replaces what it wrote before."""
    if verb not in VERBS:
        raise ValueError(f"unknown verb {verb!r}")

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # the numbers of lines and their counts come from one reading
        try:
            answer(numbered(kept), verb, vocabulary, policy).write.mode("overwrite").json(f"{sink}/batch={number}")
        finally:
            kept.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: events by type in tumbling windows, late ones dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_windows(events: DataFrame, sink: str, checkpoint: str):
    """The windowed counts of a stream of events; each trigger replaces the table of all windows."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/windows")

    return windowed_counts(events).writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
