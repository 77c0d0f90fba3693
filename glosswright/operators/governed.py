"""Verbs over identifiers: expand, check, normalize, render, audit.  Relational throughout.

Identifiers are a relation (id, identifier).  Distinct tokens meet the vocabulary once; sequences are put
together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import is_upper_snake, phrase_key, split_identifier, title_case, unaccounted
from .vocabulary import Policy, Vocabulary

DEFAULT_CLASS_WORD = "VAL"
#: Tokens that begin with digits beyond which they are joined and not sent with the plan.
JOINABLE = 10_000


def tokens_of(ids: DataFrame, vocabulary: Vocabulary | None = None, empty: bool = False) -> DataFrame:
    """(id, identifier, pos, token); with a vocabulary, digits join the next token when it knows the two as one.

    With `empty`, a name without tokens has one row of nulls.
    """
    explode = F.posexplode_outer if empty else F.posexplode
    parts = split_identifier(F.col("identifier"))
    rows = ids.select("id", "identifier", explode(parts).alias("pos", "token"))
    if vocabulary is None:
        return rows
    known = vocabulary.catalog.select("token").union(vocabulary.overlay.select("token")).union(vocabulary.allow.select("token")).where(F.col("token").rlike(r"^\d+\p{L}")).distinct()
    known = vocabulary.small(known, "digits first")
    joinable = [r["token"] for r in known.limit(JOINABLE + 1).collect()]  # tokens that begin with digits
    if not joinable:
        return rows
    every = F.array(*map(F.lit, joinable))
    if len(joinable) > JOINABLE:  # each identifier brings those of its own adjacent pairs that are known
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.element_at(parts, i).alias("a"), F.element_at(parts, i + 1).alias("b")))
        pairs = ids.where(F.size(parts) > 1).select("identifier", F.explode(pairs).alias("p")).where(F.col("p.a").rlike(r"^\d+$"))
        pairs = pairs.select("identifier", F.upper(F.concat("p.a", "p.b")).alias("token")).join(known, "token", "left_semi")
        ids = ids.select("id", "identifier").join(pairs.groupBy("identifier").agg(F.collect_set("token").alias("every")), "identifier", "left")
        every = F.coalesce("every", F.array().cast("array<string>"))

    def step(state: Column, t: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        joins = last.rlike(r"^\d+$") & F.array_contains(every, F.upper(F.concat(last, t)))
        joined = F.concat(F.slice(state, 1, F.greatest(F.size(state) - 1, F.lit(0))), F.array(F.concat(last, t)))
        return F.when(joins, joined).otherwise(F.concat(state, F.array(t)))

    return ids.select("id", "identifier", explode(F.aggregate(parts, F.array().cast("array<string>"), step)).alias("pos", "token"))


def expand_tokens(tokens: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """tokens with long, is_known, source, entry_id, confidence, kind, class_word, beaten."""
    answers = vocabulary.small(vocabulary.resolved(policy).withColumnRenamed("token", "upper"), f"resolved {policy.mode} {policy.allow_override}")
    words = vocabulary.small(vocabulary.class_words().select(F.col("token").alias("upper"), F.col("class_word").alias("class")), "class words")
    rows = tokens.withColumn("upper", F.upper("token")).join(answers, "upper", "left").join(words, "upper", "left")
    unknown = F.col("long").isNull()
    passed = title_case(F.col("token"))
    if policy.unknown == "reject":
        passed = F.raise_error(F.concat(F.lit("unknown token "), F.col("token"))).cast("string")
    return rows.select(
        *tokens.columns,
        F.when(unknown, passed).otherwise(F.col("long")).alias("long"),
        (~unknown).alias("is_known"),
        F.coalesce("source", F.lit("passthrough")).alias("source"),
        "entry_id",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("kind", F.lit("passthrough")).alias("kind"),
        F.coalesce("class_word", "class").alias("class_word"),
        F.coalesce("keep", F.lit(False)).alias("keep"),
        "canonical",
        F.filter(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: c != F.col("long")).alias("beaten"),
    )


def _names(rows: DataFrame, *columns: str) -> DataFrame:
    """(id, identifier, t): the tokens of each name as an array in order, put together by one shuffle."""
    token = F.when(F.col("token").isNotNull(), F.struct("pos", *columns))
    return rows.groupBy("id", "identifier").agg(F.array_sort(F.collect_list(token)).alias("t"))


def _expansion(t: Column) -> list[Column]:
    odd = F.array_join(unaccounted(F.col("identifier")), "")
    return [
        F.array_join(F.transform(t, lambda x: x["long"]), " ").alias("logical_name"),
        (F.forall(t, lambda x: x["is_known"]) & (odd == "")).alias("fully_known"),
        F.coalesce(F.array_min(F.transform(t, lambda x: x["confidence"])), F.lit(0.0)).alias("confidence"),
        F.try_element_at(t, F.lit(-1))["class_word"].alias("class_word"),
        F.size(t).cast("long").alias("n_tokens"),
        odd.alias("unaccounted"),
    ]


def expand_identifiers(ids: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(id, identifier, logical_name, fully_known, confidence, class_word, n_tokens, unaccounted)."""
    rows = expand_tokens(tokens_of(ids, vocabulary, empty=True), vocabulary, policy)
    return _names(rows, "long", "is_known", "confidence", "class_word").select("id", "identifier", *_expansion(F.col("t")))


def _judged(ids: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """Tokens with verdict, code and fix; tokens without a letter have no code."""
    rows = expand_tokens(tokens_of(ids, vocabulary, empty=True), vocabulary, policy).withColumn("upper", F.upper("token"))
    rank = F.expr("case list when 'approved_abbreviations' then 0 when 'common_keywords' then 1 else 2 end")
    lists = vocabulary.small(vocabulary.allow.groupBy("token").agg(F.min(rank).alias("listed")).withColumnRenamed("token", "upper"), "lists")
    approved = vocabulary.small(vocabulary.approved().select(F.col("token").alias("upper"), F.lit(True).alias("approved")), "approved")
    back = vocabulary.reverse().join(vocabulary.approved().withColumnRenamed("token", "short"), "short", "left_semi")
    back = vocabulary.small(back.select(F.col("key").alias("canonical_key"), "short"), "approved reverse")
    rows = rows.join(lists, "upper", "left").join(approved, "upper", "left").withColumn("canonical_key", phrase_key(F.col("canonical"))).join(back, "canonical_key", "left")
    code = (
        F.when(~F.col("upper").rlike(r"\p{L}"), F.lit(None).cast("string"))
        .when(F.col("source") == "custom", "custom_abbrev")
        .when(F.col("listed") == 0, "approved_abbrev")
        .when(F.col("listed") == 1, "common_keyword")
        .when(F.col("listed") == 2, "short_full_word")
        .when(F.col("is_known") & (F.col("kind") == "proper_noun_acronym"), "proper_noun_acronym")
        .when(F.col("is_known") & (F.col("kind") == "short_full_word"), "short_full_word")
        .when(F.col("is_known") & ((F.col("kind") == "class_word_abbrev") | F.col("keep") | F.coalesce("approved", F.lit(False))), "approved_abbrev")
        .when(F.coalesce("approved", F.lit(False)), "approved_abbrev")
        .otherwise("unapproved_abbrev")
    )
    failed = code == "unapproved_abbrev"
    fix = F.when(failed & F.col("is_known") & (F.col("short") != F.col("upper")), F.col("short"))
    return rows.select("id", "identifier", "pos", "token", "upper", "long", "is_known", "confidence", code.alias("code"), fix.alias("fix"), "class_word")


def _judged_names(ids: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(id, identifier, t, findings): each name with all that the verbs say of its tokens and of itself."""
    names = _names(_judged(ids, vocabulary, policy), "token", "upper", "long", "is_known", "confidence", "code", "fix", "class_word")
    return names.withColumn("findings", _findings(F.col("t"), policy, _has_default(vocabulary)))


def _has_default(vocabulary: Vocabulary) -> bool:
    words = vocabulary.small(vocabulary.class_words().select("token"), "class tokens")
    return bool(words.where(F.col("token") == DEFAULT_CLASS_WORD).limit(1).count())


def _findings(t: Column, policy: Policy, has_default: bool) -> Column:
    """array<struct(seq, token, verdict, code, fix)>: one finding for each token with a letter, then those on the name."""
    nothing = F.lit(None).cast("string")
    of_tokens = F.transform(F.filter(t, lambda x: x["code"].isNotNull()), lambda x: F.struct(x["pos"].alias("seq"), x["token"].alias("token"), F.when(x["code"] == "unapproved_abbrev", "fail").otherwise("pass").alias("verdict"), x["code"].alias("code"), x["fix"].alias("fix")))
    upper = F.array_join(F.transform(t, lambda x: x["upper"]), "_")
    fixed = F.array_join(F.transform(t, lambda x: F.coalesce(x["fix"], x["upper"])), "_")
    some, over = F.size(t) > 0, F.length("identifier") > policy.max_name_length

    def finding(condition, seq, code, fix):
        return F.when(condition, F.struct(F.lit(seq).alias("seq"), nothing.alias("token"), F.lit("fail").alias("verdict"), F.lit(code).alias("code"), fix.alias("fix")))

    of_name = F.array(
        finding(~some, 0, "empty_name", nothing),
        finding(some & ~is_upper_snake(F.col("identifier")), 1_000_000, "not_upper_snake", upper),
        finding(some & F.lit(policy.require_trailing_class_word) & F.try_element_at(t, F.lit(-1))["class_word"].isNull(), 1_000_001, "missing_class_word", F.concat(upper, F.lit("_" + DEFAULT_CLASS_WORD)) if has_default else nothing),
        finding(some & F.lit(policy.enforce_name_length) & over, 1_000_002, "exceeds_max_length", F.when((fixed != F.col("identifier")) & (F.length(fixed) <= policy.max_name_length), fixed)),
    )
    return F.concat(of_tokens, F.array_compact(of_name))


def compliance_findings(ids: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(id, seq, token, verdict, code, fix): one finding for each token, then those on the whole name."""
    return _judged_names(ids, vocabulary, policy).select("id", F.explode("findings").alias("f")).select("id", "f.*")


def judged(ids: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(id, identifier, findings): the findings of each name in order."""
    return _judged_names(ids, vocabulary, policy).select("id", "identifier", "findings")


def audit_names(ids: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(id, identifier, occurrences, is_fully_known, compliant, unknown_tokens, codes, normalized) of each name."""
    rows = _judged_names(ids, vocabulary, policy)
    unknown = F.transform(F.filter("t", lambda x: ~x["is_known"]), lambda x: x["upper"])
    codes = F.array_distinct(F.transform(F.filter("findings", lambda f: f["verdict"] == "fail"), lambda f: f["code"]))
    return rows.select("id", "identifier", F.lit(1).alias("occurrences"), _expansion(F.col("t"))[1].alias("is_fully_known"), (_failures() == 0).alias("compliant"), unknown.alias("unknown_tokens"), codes.alias("codes"), _normalized().alias("normalized"))


def _failures() -> Column:
    return F.size(F.filter("findings", lambda f: f["verdict"] == "fail")).cast("long")


def compliance_summary(ids: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(id, compliant, n_findings, n_failures)."""
    return _judged_names(ids, vocabulary, policy).select("id", (_failures() == 0).alias("compliant"), F.size("findings").cast("long").alias("n_findings"), _failures().alias("n_failures"))


def _normalized() -> Column:
    return F.array_join(F.transform("t", lambda x: F.coalesce(x["fix"], x["upper"])), "_")


def normalize(ids: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(id, identifier, normalized): tokens in capitals, those with an approved form replaced by it."""
    names = _names(_judged(ids, vocabulary, policy), "upper", "fix")
    return names.select("id", "identifier", _normalized().alias("normalized"))


def to_physical(names: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """(id, logical, physical, confidence, term_id) of (id, logical).

    A word that is a governed token passes as it is; else the longest run of words with a short form is
    rendered; else the word in capitals.  Spans meet the reverse index in one join, at most as long as the
    wordiest long form; a fold then takes them from left to right.
    """
    over = vocabulary.overlay.select(phrase_key(F.col("canonical")).alias("key"), F.col("token").alias("short"), F.lit(1.0).alias("confidence"), F.lit(0).alias("rank"))
    index = vocabulary.reverse().withColumn("rank", F.lit(1)).unionByName(over)
    index = vocabulary.small(index.groupBy("key").agg(F.min_by(F.struct("short", "confidence"), F.struct("rank", "short")).alias("e")).select("key", "e.short", "e.confidence"), "index")
    widest = index.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1
    governed = vocabulary.catalog.select("token", "confidence").union(vocabulary.overlay.select("token", F.lit(1.0))).union(vocabulary.approved().select("token", F.lit(1.0))).groupBy("token").agg(F.min("confidence").alias("confidence"))
    words = names.withColumn("w", F.filter(F.split(F.regexp_replace(F.coalesce("logical", F.lit("")), r"[_\s]+", " "), " "), lambda x: x != ""))
    span = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(widest), F.size("w") - i)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("text"))))))
    spans = words.where(F.size("w") > 0).select("id", span.alias("s")).select("id", "s.*")
    spans = spans.join(index, phrase_key(F.col("text")) == F.col("key"), "left")
    keep = vocabulary.small(governed.select(F.col("token").alias("own"), F.col("confidence").alias("own_confidence")), "own")
    exact = F.col("text").rlike(r"\p{L}") & (F.upper("text") == F.col("text"))
    spans = spans.join(keep, (F.col("n") == 1) & exact & (F.col("text") == F.col("own")), "left")
    approved = vocabulary.small(vocabulary.approved().select(F.col("token").alias("ok")), "ok")
    spans = spans.join(approved, (F.col("n") == 1) & (F.upper("text") == F.col("ok")), "left")
    short = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("short").isNotNull(), F.col("short")).when(F.col("n") == 1, F.upper("text"))
    sure = F.when(F.col("own").isNotNull(), F.col("own_confidence")).when(F.col("short").isNotNull(), F.col("confidence")).otherwise(F.when(F.col("ok").isNotNull(), 1.0).otherwise(0.0))
    choice = spans.select("id", "at", "n", short.alias("short"), sure.alias("sure"), F.col("own").isNotNull().alias("own")).where("short is not null")
    best = choice.groupBy("id", "at").agg(F.max_by(F.struct("n", "short", "sure"), F.struct(F.col("own").cast("int"), "n")).alias("b"))
    ordered = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("b.n").alias("n"), F.col("b.short").alias("short"), F.col("b.sure").alias("sure")))).alias("b"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"), F.lit(1.0).alias("sure"))

    def take(state: Column, x: Column) -> Column:
        here = x["at"] >= state["free"]
        return F.struct(F.when(here, x["at"] + x["n"]).otherwise(state["free"]).alias("free"), F.when(here, F.concat(state["out"], F.array(x["short"]))).otherwise(state["out"]).alias("out"), F.when(here, F.least(state["sure"], x["sure"])).otherwise(state["sure"]).alias("sure"))

    done = ordered.withColumn("f", F.aggregate("b", start, take)).select("id", F.array_join("f.out", "_").alias("physical"), F.col("f.sure").alias("confidence"), F.element_at("f.out", -1).alias("last"))
    if policy.append_class_word_when_missing:
        if _has_default(vocabulary):
            last = vocabulary.class_words().select(F.col("token").alias("last"), F.col("class_word").alias("cw"))
            done = done.join(vocabulary.small(last, "last class words"), "last", "left")
            done = done.withColumn("physical", F.when(F.col("cw").isNull(), F.concat("physical", F.lit("_" + DEFAULT_CLASS_WORD))).otherwise(F.col("physical")))
    out = names.join(done.select("id", "physical", "confidence"), "id", "left").withColumn("key", phrase_key(F.col("logical")))
    out = out.join(vocabulary.small(vocabulary.terms.select("key", "term_id"), "terms"), "key", "left")
    return out.select("id", "logical", F.coalesce("physical", F.lit("")).alias("physical"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "term_id")


class Audit:
    """Counters over a corpus of identifiers, weighted by rows; each verb runs once for each distinct name."""

    def __init__(self, identifiers: DataFrame, vocabulary: Vocabulary, policy: Policy, examples: int = 3):
        if policy.unknown == "reject":
            raise ValueError("an audit counts unknown tokens; a policy that rejects them cannot be audited")
        self.vocabulary, self.policy, self.examples = vocabulary, policy, examples
        name = F.coalesce("identifier", F.lit(""))
        self.names = identifiers.groupBy(name.alias("identifier")).agg(F.count("*").alias("occurrences"), F.min("id").alias("id"))
        self.ids = self.names.select("id", "identifier")

    def observed(self) -> DataFrame:
        """Each distinct name once, with its occurrences and all that the verbs say of it; one pass over the tokens."""
        return _judged_names(self.names.select("id", "identifier"), self.vocabulary, self.policy).join(self.names, ["id", "identifier"])

    def summary(self) -> DataFrame:
        rows = self.observed().select("occurrences", *_expansion(F.col("t")), F.exists("t", lambda x: x["is_known"]).alias("some"), (_failures() == 0).alias("compliant"))

        def weigh(condition, name):
            return F.sum(F.when(condition, F.col("occurrences")).otherwise(0)).alias(name)

        return rows.agg(F.sum("occurrences").alias("identifiers"), F.count("*").alias("distinct_identifiers"), weigh(F.col("n_tokens") == 0, "empty"), weigh(F.col("fully_known"), "fully_known"), weigh(~F.col("fully_known") & F.col("some"), "partially_known"), weigh(F.col("compliant"), "compliant"))

    def _unknown(self) -> DataFrame:
        """(token, id, identifier, occurrences, k): unknown tokens of each distinct name, k times in it."""
        rows = expand_tokens(tokens_of(self.ids, self.vocabulary), self.vocabulary, self.policy).where("not is_known")
        return rows.groupBy(F.upper("token").alias("token"), "id", "identifier").agg(F.count("*").alias("k")).join(self.names.select("id", "occurrences"), "id")

    def backlog(self) -> DataFrame:
        """(token, occurrences, identifier_rows, examples): unknown tokens; those without a letter are left out.

        Tasks combine sums and their first few examples before the shuffle, so a token that most names hold is no burden.
        """
        rows = self._unknown().where(F.col("token").rlike(r"\p{L}"))
        sums = rows.groupBy("token").agg(F.sum(F.col("k") * F.col("occurrences")).alias("occurrences"), F.sum("occurrences").alias("identifier_rows"))
        part = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
        order = Window.partitionBy("token", "part").orderBy("id")
        near = part.withColumn("r", F.row_number().over(order)).where(F.col("r") <= self.examples)
        order = Window.partitionBy("token").orderBy("id")
        first = near.select("token", "id", "identifier").withColumn("r", F.row_number().over(order)).where(F.col("r") <= self.examples)
        shown = first.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "identifier"))), lambda x: x["identifier"]), "|").alias("examples"))
        return sums.join(shown, "token")

    def ordinals(self) -> DataFrame:
        """(token, occurrences): unknown tokens without a letter, counted apart."""
        rows = self._unknown().where(~F.col("token").rlike(r"\p{L}"))
        return rows.groupBy("token").agg(F.sum(F.col("k") * F.col("occurrences")).alias("occurrences"))

    def findings(self) -> DataFrame:
        """(code, occurrences): failures by reason."""
        rows = self.observed().select("occurrences", F.explode("findings").alias("f")).where("f.verdict = 'fail'")
        return rows.groupBy("f.code").agg(F.sum("occurrences").alias("occurrences"))

    def round_trip(self) -> DataFrame:
        """(id, identifier, logical, rendered, outcome): stable, corrected or inconsistent."""
        names = _judged_names(self.ids, self.vocabulary, self.policy).select("id", "identifier", *_expansion(F.col("t"))[:1], _normalized().alias("normalized"))
        names = names.withColumnRenamed("logical_name", "logical")
        back = to_physical(names.select("id", "logical"), self.vocabulary, self.policy.but(append_class_word_when_missing=False)).select("id", F.col("physical").alias("rendered"))
        outcome = F.when(F.col("rendered") == F.col("identifier"), "stable").when(F.col("rendered") == F.col("normalized"), "corrected").otherwise("inconsistent")
        return names.join(back, "id").select("id", "identifier", "logical", "rendered", outcome.alias("outcome"))

    def suggestions(self, limit: int | None = None) -> DataFrame:
        """(token, occurrences, proposal): the backlog, with a short form where the token is a governed word.

        With a limit, the most frequent first, then by token; a DataFrame without one has no order of its own.
        """
        index = self.vocabulary.reverse().join(self.vocabulary.approved().withColumnRenamed("token", "short"), "short", "left_semi")
        rows = self.backlog().join(self.vocabulary.small(index), F.lower("token") == F.col("key"), "left").select("token", "occurrences", F.col("short").alias("proposal"))
        return rows.orderBy(F.desc("occurrences"), "token").limit(limit) if limit else rows
