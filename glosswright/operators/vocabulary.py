"""The governed vocabulary as small relations, and the resolution of tokens under a policy."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.identifiers import canonical_form_score, phrase_key

CATALOG_SCHEMA = "ord int, token string, canonical string, candidates array<string>, pin string, kind string, keep_as_abbrev boolean, class_word string, entry_id string, source string, confidence double"
OVERLAY_SCHEMA = "layer int, token string, canonical string, entry_id string, confidence double, kind string, keep_as_abbrev boolean, class_word string, candidates array<string>"
#: A vocabulary beyond this many rows is joined by shuffle instead of being sent to every executor.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Policy:
    """How tokens resolve and what a name must satisfy."""

    mode: str = "governed"
    allow_override: bool = True
    unknown: str = "passthrough_titlecase"
    neural_fallback: bool = False
    governed_hit_is_final: bool = True
    enforce_name_length: bool = False
    max_name_length: int = 30
    require_trailing_class_word: bool = True
    append_class_word_when_missing: bool = True

    def __post_init__(self):
        if self.mode not in ("governed", "most_common"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.unknown not in ("passthrough_titlecase", "neural", "reject"):
            raise ValueError(f"unknown way with unknown tokens {self.unknown!r}")
        if self.max_name_length < 1:
            raise ValueError("max_name_length must be positive")

    def but(self, **changes) -> Policy:
        return replace(self, **changes)


POLICIES = {
    "governed_default": Policy(),
    "frequency_baseline": Policy(mode="most_common", allow_override=False, require_trailing_class_word=False),
    "neural_optin": Policy(unknown="neural", neural_fallback=True),
    "strict_length": Policy(enforce_name_length=True, max_name_length=30),
}


class Vocabulary:
    """Catalog, overlay, allow-lists, class words and terms; every token upper-cased.

    catalog: CATALOG_SCHEMA.  overlay: (layer, token, canonical), and any of entry_id, confidence, kind,
    keep_as_abbrev, class_word and candidates; the highest layer of a token wins, blank ones are dropped.
    allow: (list, token) with lists approved_abbreviations, common_keywords and short_full_words.
    classes: (abbrev, full).  terms: (logical_name, term_id).
    """

    def __init__(self, catalog: DataFrame, overlay: DataFrame, allow: DataFrame, classes: DataFrame, terms: DataFrame):
        up = F.upper(F.trim("token"))
        self.catalog = catalog.withColumn("token", up)
        top = Window.partitionBy("token").orderBy(F.desc("layer"))
        given = {"entry_id": F.lit(None).cast("string"), "confidence": F.lit(1.0), "kind": F.lit("approved_abbrev"), "keep_as_abbrev": F.lit(False), "class_word": F.lit(None).cast("string"), "candidates": F.array().cast("array<string>")}
        own = [F.coalesce(c, v).alias(c) if c in overlay.columns else v.alias(c) for c, v in given.items()]
        overlay = overlay.select("layer", up.alias("token"), F.trim(F.regexp_replace("canonical", r"\s+", " ")).alias("canonical"), *own)
        self.overlay = overlay.where("token <> '' and canonical <> ''").withColumn("r", F.row_number().over(top)).where("r = 1").drop("layer", "r")
        self.allow = allow.withColumn("token", up)
        self.classes = classes
        self.terms = terms.withColumn("key", phrase_key(F.col("logical_name")))
        self.spark = catalog.sparkSession
        self._kept: dict[str, DataFrame] = {}

    def small(self, df: DataFrame, key: str = "") -> DataFrame:
        """df as a broadcast local relation when it has at most BROADCAST_ROWS rows, else as it is.

        The rows are worked out once for each key, so that the verbs of one vocabulary share them and
        their plans hold lookups only.
        """
        if key and key in self._kept:
            return self._kept[key]
        rows = df.limit(BROADCAST_ROWS + 1).toArrow()
        out = F.broadcast(self.spark.createDataFrame(rows, df.schema)) if rows.num_rows <= BROADCAST_ROWS else df
        if key:
            self._kept[key] = out
        return out

    def scored(self) -> DataFrame:
        """(token, best): the best-scored candidate of each row with more than one."""
        rows = self.catalog.where(F.size("candidates") > 1).select("token", F.explode("candidates").alias("candidate"))
        order = Window.partitionBy("token").orderBy(canonical_form_score(F.col("candidate"), F.col("token")), "candidate")
        return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("token", F.col("candidate").alias("best"))

    def resolved(self, policy: Policy) -> DataFrame:
        """(token, long, source, entry_id, confidence, kind, keep, class_word, candidates) of all known tokens."""
        base = self.catalog.join(self.scored(), "token", "left")
        if policy.mode == "most_common":
            long = F.coalesce(F.try_element_at("candidates", F.lit(1)), "canonical")
            how = F.when(F.col("keep_as_abbrev") & (long != F.col("canonical")), F.lit("governed"))
        else:
            long = F.coalesce("pin", "best", "canonical")
            how = F.when(F.col("pin").isNotNull(), F.lit("pinned")).when(F.col("best").isNotNull(), F.lit("scored"))
        source = F.coalesce(how, F.when(F.col("keep_as_abbrev"), F.lit("approved")).otherwise(F.lit("governed")))
        own = base.select("token", long.alias("long"), source.alias("source"), "entry_id", "confidence", "kind", F.col("keep_as_abbrev").alias("keep"), "class_word", "candidates", "canonical")
        over = self.overlay.select("token", F.col("canonical").alias("custom"), F.struct("entry_id", "confidence", "kind", F.col("keep_as_abbrev").alias("keep"), "class_word", "candidates").alias("o"))
        both = own.join(over, "token", "full")
        wins = F.col("custom").isNotNull() & (F.col("long").isNull() | F.lit(policy.allow_override) | (phrase_key(F.col("custom")) == phrase_key(F.col("long"))))
        word = F.concat(F.upper(F.substring("token", 1, 1)), F.lower(F.substr(F.col("token"), F.lit(2))))
        rank = F.expr("case list when 'approved_abbreviations' then 0 when 'common_keywords' then 1 else 2 end")
        listed = self.allow.groupBy("token").agg(F.min(rank).alias("rank")).join(both.select("token"), "token", "left_anti")
        self_entry = listed.select("token", word.alias("long"), F.lit("approved").alias("source"), F.lit(None).cast("string").alias("entry_id"), F.lit(1.0).alias("confidence"), F.when(F.col("rank") == 2, F.lit("short_full_word")).otherwise(F.lit("approved_abbrev")).alias("kind"), F.lit(True).alias("keep"), F.lit(None).cast("string").alias("class_word"), F.array().cast("array<string>").alias("candidates"), word.alias("canonical"))
        fields = [F.when(wins, F.col("o")[c]).otherwise(F.col(c)).alias(c) for c in ("entry_id", "confidence", "kind", "keep", "class_word", "candidates")]
        answer = both.select("token", F.when(wins, F.col("custom")).otherwise(F.col("long")).alias("long"), F.when(wins, F.lit("custom")).otherwise(F.col("source")).alias("source"), *fields, F.when(wins, F.col("custom")).otherwise(F.col("canonical")).alias("canonical"))
        return answer.unionByName(self_entry)

    def approved(self) -> DataFrame:
        """Distinct tokens that the vocabulary approves."""
        return self.overlay.select("token").union(self.catalog.where("keep_as_abbrev").select("token")).union(self.allow.select("token")).distinct()

    def reverse(self) -> DataFrame:
        """(key, short, confidence): long form to token; an exact canonical first, then the shortest, then by text."""
        forms = self.catalog.select("token", "canonical", "confidence", F.explode(F.array_union(F.array("canonical"), F.coalesce("candidates", F.array().cast("array<string>")))).alias("form"))
        forms = forms.select("token", "confidence", phrase_key(F.col("form")).alias("key"), (phrase_key(F.col("form")) != phrase_key(F.col("canonical"))).cast("int").alias("rank"))
        order = Window.partitionBy("key").orderBy("rank", F.length("token"), "token")
        return forms.withColumn("r", F.row_number().over(order)).where("r = 1").select("key", F.col("token").alias("short"), "confidence")

    def class_words(self) -> DataFrame:
        """(token, class_word): a token's own, else what the abbreviation map or the full-form map says."""
        over = self.overlay.select("token", "class_word", F.lit(-1).alias("rank"))
        own = self.catalog.select("token", "class_word", F.lit(0).alias("rank"))
        own = over.union(own.join(over.select("token"), "token", "left_anti")).where("class_word is not null")  # an overlay row hides the catalog's
        short = self.classes.select(F.upper("abbrev").alias("token"), F.col("full").alias("class_word"), F.lit(1).alias("rank"))
        full = self.classes.select(F.upper("full").alias("token"), F.col("full").alias("class_word"), F.lit(2).alias("rank"))
        return own.union(short).union(full).groupBy("token").agg(F.min_by("class_word", "rank").alias("class_word"))


def literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A few literal rows as a local relation, whose size the optimizer knows."""
    kinds = T.StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kinds, strict=True)], kinds.names), kinds)


def vocabulary(spark: SparkSession, catalog, overlay=(), allow=(), classes=(), terms=()) -> Vocabulary:
    """A Vocabulary from literal rows: the driver holds them, so one partition does, and nothing of it is shuffled."""
    parts = [
        literal(spark, [(i, *r) for i, r in enumerate(catalog)], CATALOG_SCHEMA),
        literal(spark, list(overlay), OVERLAY_SCHEMA if overlay and len(overlay[0]) > 3 else "layer int, token string, canonical string"),
        literal(spark, list(allow), "list string, token string"),
        literal(spark, list(classes), "abbrev string, full string"),
        literal(spark, list(terms), "logical_name string, term_id string"),
    ]
    return Vocabulary(*(p.coalesce(1) for p in parts))


def from_mapping(pairs: DataFrame) -> DataFrame:
    """Catalog (token, canonical) of (ord, short, long): white space collapsed, blank rows dropped, the last wins."""
    clean = pairs.select("ord", F.upper(F.trim("short")).alias("token"), F.trim(F.regexp_replace("long", r"\s+", " ")).alias("canonical")).where("token <> '' and canonical <> ''")
    return clean.groupBy("token").agg(F.max_by("canonical", "ord").alias("canonical"))


def invert(pairs: DataFrame) -> DataFrame:
    """Catalog of (ord, long, short): long forms that share a short one are scored candidates in source order."""
    clean = pairs.select("ord", F.upper(F.trim("short")).alias("token"), F.trim(F.regexp_replace("long", r"\s+", " ")).alias("long")).where("token <> '' and long <> ''")
    first = clean.groupBy("token", "long").agg(F.min("ord").alias("ord"))
    best = Window.partitionBy("token").orderBy(canonical_form_score(F.col("long"), F.col("token")), "long")
    rows = first.withColumn("r", F.row_number().over(best))
    out = rows.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("ord", "long"))).alias("c"), F.max(F.when(F.col("r") == 1, F.col("long"))).alias("canonical"))
    many = F.size("c") > 1
    return out.select("token", "canonical", F.transform("c", lambda x: x["long"]).alias("candidates"), F.when(many, 0.5).otherwise(1.0).alias("confidence"), F.when(many, F.lit("scored")).otherwise(F.lit("governed")).alias("source"), F.when(many, F.lit("ambiguous_pinned")).otherwise(F.lit("approved_abbrev")).alias("kind"))


def merge_pins(catalog: DataFrame, pins: DataFrame) -> DataFrame:
    """Catalog (token, canonical, candidates, pin) with a pin sheet (token, candidates, pin) merged in.

    Missing pins and candidates are filled; tokens only on the sheet become rows (pinned, or scored at 0.5);
    pins or candidate sets that contradict each other fail the query.
    """
    c = catalog.select("token", "canonical", F.col("candidates").alias("c"), F.col("pin").alias("p"))
    s = pins.select(F.upper("token").alias("token"), F.col("candidates").alias("sc"), F.col("pin").alias("sp"))
    both = c.join(s, "token", "full")
    clash = (F.col("p") != F.col("sp")) | ((F.size("c") > 0) & (F.size("sc") > 0) & (F.array_sort("c") != F.array_sort("sc")))
    checked = F.when(clash, F.raise_error(F.concat(F.lit("contradicting pins for "), "token"))).otherwise(F.coalesce("p", "sp"))
    pin = checked.cast("string")
    cands = F.when(F.size("c") > 0, F.col("c")).otherwise(F.coalesce("sc", "c"))
    minted = F.col("canonical").isNull()
    return both.select("token", F.coalesce("canonical", "sp", F.try_element_at("sc", F.lit(1))).alias("canonical"), cands.alias("candidates"), pin.alias("pin"), minted.alias("minted"), F.when(minted & F.col("sp").isNull(), 0.5).otherwise(1.0).alias("confidence"))
