"""Readers and writers.  Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.vocabulary import from_mapping, invert

ENTRY = "token string, canonical string, candidates array<string>, pin string, kind string, keep_as_abbrev boolean, class_word string, entry_id string, source string, confidence double"


def catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of a JSON file {"entries": [...]} or [...]; a row without token or canonical fails the query."""
    raw = spark.read.schema(f"entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>, {ENTRY}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    nested = raw.where("entries is not null").select(F.posexplode("entries").alias("ord", "e")).select("ord", "e.*")
    flat = raw.where("entries is null").select(F.monotonically_increasing_id().cast("int").alias("ord"), *[c.split()[0] for c in ENTRY.split(", ")])
    rows = nested.unionByName(flat)
    bad = F.col("token").isNull() | F.col("canonical").isNull() | (F.trim("token") == "")
    return rows.withColumn("token", F.when(bad, F.raise_error(F.concat(F.lit("catalog row without token or canonical at position "), F.col("ord").cast("string"))).cast("string")).otherwise(F.upper(F.trim("token"))))


def pairs_csv(spark: SparkSession, path: str, key: str, value: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(ord, key, value) of two named columns; a byte order mark is dropped, rows with a blank side are skipped.

    ord follows the order of the file's rows within a split and of the splits.
    """
    rows = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    names = {c.lstrip("﻿").strip(): c for c in rows.columns}
    missing = [c for c in (key, value) if c not in names]
    if missing:
        raise ValueError(f"no column {missing[0]!r} among {sorted(names)}")
    out = rows.select(F.monotonically_increasing_id().alias("ord"), F.trim(F.col(f"`{names[key]}`")).alias("key"), F.trim(F.col(f"`{names[value]}`")).alias("value"))
    return out.where("key <> '' and value <> ''")


def catalog_csv(spark: SparkSession, path: str, token: str, canonical: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Catalog (token, canonical) of two named columns, the last row of a token wins."""
    return from_mapping(pairs_csv(spark, path, token, canonical, sep, encoding).select("ord", F.col("key").alias("short"), F.col("value").alias("long")))


def long_to_short_csv(spark: SparkSession, path: str, long: str, short: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Catalog of a file that lists long forms with their short ones: a long form's last row wins, collisions are scored."""
    rows = pairs_csv(spark, path, long, short, sep, encoding)
    last = rows.groupBy(F.col("key").alias("long")).agg(F.min("ord").alias("ord"), F.max_by("value", "ord").alias("short"))
    return invert(last)


def term_index(spark: SparkSession, path: str, name: str = "logical_name", term: str = "term_id") -> DataFrame:
    """(logical_name, term_id), the last row of a name wins."""
    rows = pairs_csv(spark, path, name, term)
    key = F.lower(F.trim(F.regexp_replace("key", r"\s+", " ")))
    return rows.groupBy(key.alias("k")).agg(F.max_by("key", "ord").alias("logical_name"), F.max_by("value", "ord").alias("term_id")).drop("k")


def lexicon_text(spark: SparkSession, path: str) -> DataFrame:
    """(word): one word a line, folded; # begins a comment; white space within an entry fails the query."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    bad = line.rlike(r"\s")
    rows = spark.read.text(path).select(F.when(bad, F.raise_error(F.concat(F.lit("white space within "), line)).cast("string")).otherwise(F.lower(line)).alias("word"))
    return rows.where("word <> ''").distinct()


def stop_words_json(spark: SparkSession, path: str) -> DataFrame:
    """(category, word) of {"categories": {category: [words]}}, {category: [words]} or a flat [words], whose category is other.

    Keys of the second form that do not hold lists, and those that begin with an underscore, are passed over.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    groups = F.coalesce(F.try_variant_get("v", "$.categories", "map<string, variant>"), F.try_variant_get("v", "$", "map<string, variant>"))
    nested = raw.select(F.explode(groups).alias("category", "words")).where(~F.col("category").startswith("_")).select("category", F.try_variant_get("words", "$", "array<string>").alias("words"))
    flat = raw.select(F.lit("other").alias("category"), F.try_variant_get("v", "$", "array<string>").alias("words"))
    words = nested.union(flat).where("words is not null").select("category", F.explode("words").alias("word"))
    return words.select("category", F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()


def dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """(src, ord, short, long) of {short: [longs]}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("short", "longs")).select(F.lit(0).alias("src"), "short", F.posexplode("longs").alias("ord", "long"))


def result_json(rows: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """(json) of each row, null fields kept, keys in the order of the columns."""
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns if c not in drop]), {"ignoreNullFields": "false"}).alias("json"))


#: Corpora for evaluation, read by declared shape.  Files that do not fit fail the query.
def gold_documents(spark: SparkSession, path: str) -> DataFrame:
    """(uid, text, pairs) of JSON rows {uid, text, pairs: [{short_form, long_form}]}."""
    return spark.read.schema("uid string, identifier string, text string, pairs array<struct<short_form:string,long_form:string>>").option("multiLine", True).option("mode", "FAILFAST").json(path)


def gold_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(uid, identifier, text, pairs) of files of records: a line that is a number, lines of text, and indented
    lines `short|long` for the gold pairs; lines that begin with # are comments.

    Records begin at the numbers and not at blank lines, which a text may hold.
    """
    lines = spark.read.text(path).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})
    heads = F.col("value").rlike(r"^\s*\d+\s*$")
    number = F.sum(heads.cast("int")).over(Window.partitionBy("file").orderBy("at"))  # a file is one corpus
    rows = lines.withColumn("record", number).where("record > 0").withColumn("head", heads)
    gold = F.col("value").rlike(r"^\s\s.*\|") & ~F.col("head")
    fields = F.split(F.trim("value"), r"\|")
    pair = F.when(gold, F.struct(F.trim(fields[0]).alias("short_form"), F.trim(fields[1]).alias("long_form")))
    body = F.when(~gold & ~F.col("head") & ~F.col("value").rlike(r"^\s*#") & (F.trim("value") != ""), F.trim("value"))
    rows = rows.select("file", "record", "at", F.when(F.col("head"), F.trim("value")).alias("identifier"), body.alias("body"), pair.alias("pair"))
    per = rows.groupBy("file", "record").agg(F.max("identifier").alias("identifier"), F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("at", "body")))).alias("b"), F.array_sort(F.collect_list(F.when(F.col("pair").isNotNull(), F.struct("at", "pair")))).alias("p"))
    kept = F.filter(F.transform("p", lambda x: x["pair"]), lambda x: (x["short_form"] != "") & (x["long_form"] != ""))
    uid = F.concat(F.lpad((F.col("record") - 1).cast("string"), 4, "0"), F.lit(":"), "identifier")
    return per.where(F.size("b") > 0).select(uid.alias("uid"), "identifier", F.array_join(F.transform("b", lambda x: x["body"]), " ").alias("text"), kept.alias("pairs"))


def ambiguous_instances(spark: SparkSession, path: str) -> DataFrame:
    """(uid, tokens, acronym_index, expansion, key, context) of a JSON array of instances."""
    raw = spark.read.schema("id string, tokens array<string>, acronym int, expansion string").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.col("id").alias("uid"), "tokens", F.col("acronym").alias("acronym_index"), "expansion", F.get("tokens", F.col("acronym")).alias("key"), F.array_join("tokens", " ").alias("context"))


def tagged_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(uid, idx, token, pos_tag, tag) of lines `token pos … tag`; blank lines part the sentences of each file."""
    lines = spark.read.text(path, wholetext=False).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})
    blank = F.trim("value") == ""
    number = F.sum(blank.cast("int")).over(Window.partitionBy("file").orderBy("at"))  # a file is one corpus split
    words = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("s", number).where(~blank).select("file", "s", "at", words.alias("w"))
    order = Window.partitionBy("file", "s").orderBy("at")
    uid = F.concat_ws("#", "file", F.col("s").cast("string"))
    return rows.select(uid.alias("uid"), (F.row_number().over(order) - 1).alias("idx"), F.col("w")[0].alias("token"), F.try_element_at("w", F.lit(2)).alias("pos_tag"), F.element_at("w", -1).alias("tag"))


def precision_table(spark: SparkSession, path: str) -> DataFrame:
    """(grp, strategy, precision, support) of a saved table, JSON lines or Parquet by the path's ending."""
    schema = "grp string, strategy string, precision double, support long"
    return spark.read.schema(schema).parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def save_precision_table(table: DataFrame, path: str) -> None:
    rows = table.select("grp", "strategy", "precision", "support")
    if path.rstrip("/").endswith(".parquet"):
        rows.write.parquet(path)
    else:
        write_json(rows, path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines that keep null fields."""
    df.write.option("ignoreNullFields", False).json(path)
