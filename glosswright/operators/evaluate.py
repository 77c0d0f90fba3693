"""Scores of predictions against gold: multisets, ranks, classes, spans, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relaxed(c: Column) -> Column:
    """Folded, without a leading determiner and edge punctuation."""
    low = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.regexp_replace(F.regexp_replace(low, r"^(the|a|an) ", ""), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def prf(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row (tp, n_gold, n_pred, precision, recall, f1) of two multisets of rows."""
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    p = predicted.groupBy(*keys).agg(F.count("*").alias("p"))
    sums = g.join(p, keys, "full").agg(F.sum(F.least(F.coalesce("g", F.lit(0)), F.coalesce("p", F.lit(0)))).alias("tp"), F.sum(F.coalesce("g", F.lit(0))).alias("n_gold"), F.sum(F.coalesce("p", F.lit(0))).alias("n_pred"))
    precision, recall = F.coalesce(F.try_divide("tp", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "n_gold"), F.lit(0.0))
    return sums.select("tp", "n_gold", "n_pred", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 6).alias("f1"))


def recall_at(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall) of (rank of gold or null)."""
    k = F.explode(F.array(*map(F.lit, ks)))
    return ranks.withColumn("k", k).groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))), 6).alias("recall"))


def is_subsequence(short: Column, text: Column) -> Column:
    chars = F.filter(F.split(F.lower(short), ""), lambda c: c != "")
    n = F.aggregate(F.split(F.lower(text), ""), F.lit(0), lambda s, c: F.when(F.try_element_at(chars, s + 1) == c, s + 1).otherwise(s))
    return n == F.size(chars)


def initials_of(text: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.split(text, r"\s+"), lambda w: F.substring(w, 1, 1)), ""))


def bucket(short: Column, long: Column) -> Column:
    """Whether a short form is the initialism, is spelled by letters in order, or neither."""
    return F.when(F.upper(short) == initials_of(long), "initialism").when(is_subsequence(short, long), "subword").otherwise("unreachable")


def miss(short: Column, long: Column) -> Column:
    """The first cause of a missed pair that applies."""
    words = F.size(F.split(F.trim(long), r"\s+"))
    n = F.length(short)
    return (
        F.when(n < 2, "short_form_too_short")
        .when(n > 10, "short_form_too_long")
        .when(~short.rlike(r"\p{Lu}"), "no_capital")
        .when(~short.rlike(r"^[\p{L}\p{N}]"), "odd_first_character")
        .when(words > F.least(n + 5, n * 2), "long_form_too_wide")
        .when(F.lower(F.substring(long, 1, 1)) != F.lower(F.substring(short, 1, 1)), "first_letter_differs")
        .when(~is_subsequence(short, long), "not_a_subsequence")
        .otherwise("other")
    )


def classes(pairs: DataFrame) -> DataFrame:
    """One row (accuracy, macro_precision, macro_recall, macro_f1) of (gold, predicted)."""
    g = pairs.groupBy(F.col("gold").alias("c")).agg(F.count("*").alias("g"), F.sum((F.col("gold") == F.col("predicted")).cast("int")).alias("tp"))
    p = pairs.groupBy(F.col("predicted").alias("c")).agg(F.count("*").alias("p"))
    rows = g.join(p, "c", "left").withColumn("precision", F.when(F.col("p").isNull(), 1.0).otherwise(F.col("tp") / F.col("p"))).withColumn("recall", F.col("tp") / F.col("g"))
    rows = rows.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    return rows.agg(F.round(F.sum("tp") / F.sum("g"), 6).alias("accuracy"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def bio_spans(tags: DataFrame) -> DataFrame:
    """(doc_id, first, last): runs of B I I ... of (doc_id, idx, tag); an I after O begins one as well."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    rows = tags.withColumn("prev", F.lag("tag").over(order)).where("tag <> 'O'")
    begins = ((F.col("tag") == "B") | F.col("prev").isNull() | (F.col("prev") == "O")).cast("int")
    rows = rows.withColumn("span", F.sum(begins).over(order))
    return rows.groupBy("doc_id", "span").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).drop("span")


def offsets(tokens: DataFrame) -> DataFrame:
    """(doc_id, idx, token, begin, stop) when the tokens are joined by single spaces."""
    order = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("token") + 1).over(order), F.lit(0))
    return tokens.withColumn("begin", begin).withColumn("stop", F.col("begin") + F.length("token"))


def span_tokens(spans: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, begin, stop, first, last): the tokens that a character span overlaps."""
    s, t = spans.alias("s"), placed.alias("t")
    hit = s.join(t, (F.col("s.doc_id") == F.col("t.doc_id")) & (F.col("s.begin") < F.col("t.stop")) & (F.col("t.begin") < F.col("s.stop")))
    return hit.groupBy(F.col("s.doc_id").alias("doc_id"), F.col("s.begin").alias("begin"), F.col("s.stop").alias("stop")).agg(F.min("t.idx").alias("first"), F.max("t.idx").alias("last"))


def reachable(target: Column, words: Column, limit: int) -> Column:
    """Whether words, each lending up to `limit` first letters or none, can spell the target in order."""
    goal = F.upper(target)

    def grow(ends: Column, w: Column) -> Column:
        more = F.flatten(F.transform(ends, lambda e: F.filter(F.transform(F.sequence(F.lit(1), F.lit(limit)), lambda k: F.when((F.length(w) >= k) & (F.substr(goal, e + 1, k) == F.upper(F.substr(w, F.lit(1), k))) & (e + k <= F.length(goal)), e + k)), lambda x: x.isNotNull())))
        return F.array_distinct(F.concat(ends, more))

    return F.array_contains(F.aggregate(words, F.array(F.lit(0)), grow), F.length(goal))


def deduplicated(predictions: DataFrame) -> DataFrame:
    """Predictions (doc_id, short, long, …) once for each document, folded short and folded long form, the first by ord."""
    key = [F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))) for c in ("short", "long")]
    order = Window.partitionBy("doc_id", *key).orderBy("ord")
    return predictions.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def candidate_space(docs: DataFrame, most: int = 14) -> DataFrame:
    """(doc_id, short, long): every start of a long form in the `most` words before a bracketed short form, folded."""
    from .extract import Limits, is_valid_short_form
    from .reliability import bracketed

    hits = docs.select("doc_id", F.explode(bracketed(F.col("text"))).alias("h"))
    rows = hits.select("doc_id", "h.short", "h.before").where(is_valid_short_form(F.col("short"), Limits(1, 14, False)))
    starts = F.regexp_extract_all("before", F.lit(r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"), F.lit(0))  # each word with what follows it
    rows = rows.select("doc_id", "short", F.slice(starts, F.greatest(F.size(starts) - most + 1, F.lit(1)), most).alias("w")).where(F.size("w") > 0)
    spans = F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.array_join(F.slice("w", k, F.size("w")), ""))
    long = F.regexp_replace("long", r"[,;:(\s]+$", "")
    rows = rows.select("doc_id", F.lower("short").alias("short"), F.explode(spans).alias("long"))
    return rows.select("doc_id", "short", F.lower(F.trim(F.regexp_replace(long, r"\s+", " "))).alias("long")).where("long <> ''").distinct()


def space_recall(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """One row (n_gold, reachable): distinct gold pairs (doc_id, short, long) that lie in the candidate space."""
    fold = [F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))).alias(c) for c in ("short", "long")]
    wanted = gold.select("doc_id", *fold).distinct()
    hit = candidate_space(docs).withColumn("hit", F.lit(1))
    return wanted.join(hit, ["doc_id", "short", "long"], "left").agg(F.count("*").alias("n_gold"), F.count("hit").alias("reachable"))


def random_choice(instances: DataFrame, entries: DataFrame, seed: int = 0) -> DataFrame:
    """(instance, gold, predicted, expected) of instances (instance, key, gold): a candidate picked by hash, and 1 / candidates."""
    per = entries.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "expansion"))).alias("c"))
    at = F.pmod(F.xxhash64("instance", F.lit(seed)), F.size("c")).cast("int")
    return instances.join(per, "key").select("instance", "gold", F.get("c", at)["expansion"].alias("predicted"), (1 / F.size("c")).alias("expected"))


def most_frequent(instances: DataFrame, entries: DataFrame, train: DataFrame) -> DataFrame:
    """(instance, gold, predicted): the candidate most often gold in train (gold), ties and unseen ones by order."""
    seen = train.groupBy(F.col("gold").alias("expansion")).agg(F.count("*").alias("n"))
    ranked = entries.join(seen, "expansion", "left").groupBy("key").agg(F.min_by("expansion", F.struct(-F.coalesce("n", F.lit(0)), "ord")).alias("predicted"))
    return instances.join(ranked, "key").select("instance", "gold", "predicted")


def ceiling(instances: DataFrame, entries: DataFrame) -> DataFrame:
    """One row (instances, reachable): how many have their gold expansion among the candidates of their key."""
    known = entries.select("key", F.col("expansion").alias("gold"), F.lit(1).alias("hit"))
    return instances.join(known, ["key", "gold"], "left").agg(F.count("*").alias("instances"), F.count("hit").alias("reachable"))


def accuracy_by_candidates(predicted: DataFrame, entries: DataFrame) -> DataFrame:
    """(bucket, n, correct) of (key, gold, predicted), by how many candidates the key has."""
    sizes = entries.groupBy("key").agg(F.count("*").alias("k"))
    bucket = F.when(F.col("k") <= 1, "1").when(F.col("k") == 2, "2").when(F.col("k") <= 5, "3-5").when(F.col("k") <= 10, "6-10").otherwise("11+")
    return predicted.join(sizes, "key").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum((F.col("gold") == F.col("predicted")).cast("long")).alias("correct"))


def occurrences(text: Column, needle: Column) -> Column:
    """array<struct(begin, stop)> of all places of a needle in a text, overlapping ones as well.

    The text is cut before each of them, so the work is that of one scan.
    """
    n = F.length(needle)
    pieces = F.split(text, F.concat(F.lit(r"(?=\Q"), needle, F.lit(r"\E)")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
    begins = F.aggregate(pieces, none, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["begins"], F.array(s["at"])).alias("begins")))["begins"]
    found = F.filter(begins, lambda b: F.substr(text, b + 1, n) == needle)
    return F.when(n > 0, F.transform(found, lambda b: F.struct(b.alias("begin"), (b + n).alias("stop")))).otherwise(F.array().cast("array<struct<begin:int,stop:int>>"))


def located(rows: DataFrame) -> DataFrame:
    """rows (…, text, short, long) with short_span and long_span: the places of the two with the smallest gap, the leftmost ones."""
    a, b = occurrences(F.col("text"), F.col("short")), occurrences(F.col("text"), F.col("long"))
    gap = lambda s, x: F.greatest(F.lit(0), F.greatest(s["begin"], x["begin"]) - F.least(s["stop"], x["stop"]))
    pairs = F.flatten(F.transform(a, lambda s: F.transform(b, lambda x: F.struct(gap(s, x).alias("gap"), s["begin"].alias("sb"), x["begin"].alias("lb"), s.alias("s"), x.alias("l")))))
    return rows.withColumn("_p", F.array_min(pairs)).withColumns({"short_span": F.col("_p")["s"], "long_span": F.col("_p")["l"]}).drop("_p")


def matched_spans(gold: DataFrame, predicted: DataFrame, overlap: bool = False) -> DataFrame:
    """One row (tp, fp, fn) of spans (doc_id, first, last) of tokens.

    Exact: equal spans, each gold one once.  Overlap: in the order of the predictions, each takes the first gold
    span with a common token that none before it has; a fold over the spans of a document, which are few.
    """
    def spans(df, name):
        return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(name))

    rows = spans(gold, "g").join(spans(predicted, "p"), "doc_id", "full")
    none = F.array().cast("array<struct<first:int,last:int>>")
    g, p = F.coalesce(F.col("g").cast("array<struct<first:int,last:int>>"), none), F.coalesce(F.col("p").cast("array<struct<first:int,last:int>>"), none)

    def take(free: Column, x: Column) -> Column:
        fits = lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"]) if overlap else (y["first"] == x["first"]) & (y["last"] == x["last"])
        hit = F.try_element_at(F.filter(F.transform(free, lambda y, i: F.when(fits(y), i)), lambda i: i.isNotNull()), F.lit(1))
        return F.when(hit.isNull(), free).otherwise(F.filter(free, lambda y, i: i != hit))

    rows = rows.select(F.size(g).alias("g"), F.size(p).alias("p"), F.size(F.aggregate(p, g, take)).alias("left"))
    tp = F.coalesce(F.sum(F.col("g") - F.col("left")), F.lit(0))
    return rows.agg(tp.alias("tp"), (F.coalesce(F.sum("p"), F.lit(0)) - tp).alias("fp"), F.coalesce(F.sum("left"), F.lit(0)).alias("fn"))


#: Tokens that stand without a space after the one before, before the one after, or both.
ATTACH_LEFT = [".", ",", ";", ":", "!", "?", ")", "]", "}", "%", "'s", "n't", "'", "”", "’"]
ATTACH_RIGHT = ["(", "[", "{", "“", "‘", "$"]
ATTACH_BOTH = ["-", "/", "–", "—"]


def detokenized(tokens: DataFrame, tight: bool = True) -> DataFrame:
    """(doc_id, idx, token, begin, stop) when tokens are joined by spaces, in the tight style without those around punctuation."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    last = F.lag("token").over(order)
    welded = F.col("token").isin(ATTACH_LEFT + ATTACH_BOTH) | last.isin(ATTACH_RIGHT + ATTACH_BOTH) if tight else F.lit(False)
    gap = F.when(last.isNull() | F.coalesce(welded, F.lit(False)), 0).otherwise(1)
    rows = tokens.withColumn("_g", gap)
    stop = F.sum(F.col("_g") + F.length("token")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("stop", stop).withColumn("begin", F.col("stop") - F.length("token")).drop("_g").select("doc_id", "idx", "token", "begin", "stop")


def half_split(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs with `half`: 0 (development) or 1 (held out), by a hash of the identifier."""
    return docs.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)).cast("int"))
