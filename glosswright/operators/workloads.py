"""Corpora made for measuring, and why a phrase cannot give a short form."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokenize import Rules, tokens_of


def novel_identifiers(spark: SparkSession, n: int, tokens: int = 18) -> DataFrame:
    """(id, identifier): names whose every token is new, base-26 numbers after a Q."""

    def letter(v: Column, place: int) -> Column:
        return F.char(F.lit(65) + (F.floor(v / 26**place) % 26))

    def token(j: Column) -> Column:
        v = F.col("id") * tokens + j
        return F.concat(F.lit("Q"), *(letter(v, p) for p in (3, 2, 1, 0)))

    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), token), "_").alias("identifier"))


def schema_identifiers(spark: SparkSession, n: int, pool: Sequence[str], lengths: Sequence[int]) -> DataFrame:
    """(id, identifier): names of tokens picked from a pool, as long as the given lengths; tokens repeat as in a schema."""
    words, sizes = F.array(*map(F.lit, pool)), F.array(*map(F.lit, lengths))

    def token(j: Column) -> Column:
        return F.get(words, ((F.col("id") * 7919 + j * 104729 + (F.col("id") * j) % 9973) % len(pool)).cast("int"))

    size = F.get(sizes, (F.col("id") * 31 % len(lengths)).cast("int"))
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(0), size - 1), token), "_").alias("identifier"))


def representable(short: str, tokens: list[dict], limit: int, subsequence: bool = False) -> bool:
    """Whether tokens, each lending letters or none, can spell a short form in order.

    A token lends its first 1..limit letters, an acronym all of them; with `subsequence` any of its letters in order.
    """
    goal = "".join(c for c in short.upper() if c.isalnum())
    ends = {0}
    for t in tokens:
        letters = t["letters"] if t["role"] == "acronym" else t["letters"][:limit]
        if t["role"] == "acronym":
            ends |= {e + len(letters) for e in ends if letters and goal.startswith(letters, e)}
            continue
        if subsequence:
            letters = "".join(c for c in t["text"].upper() if c.isalnum())
            more, at = set(ends), set(ends)
            for c in letters:
                at |= {e + 1 for e in at if e < len(goal) and goal[e] == c}
            ends = more | at
            continue
        ends |= {e + k for e in ends for k in range(1, len(letters) + 1) if goal.startswith(letters[:k], e)}
    return len(goal) in ends


#: Causes in the order in which they are tried: what is changed of the rules, whether any letters may be lent.
CAUSES = [
    ("short words", {"shortest": 1}, False),
    ("stop words", {"stops": {}}, False),
    ("letters of a token", {"letters": 10}, False),
    ("beginnings of words only", {"letters": 10}, True),
    ("atomic acronyms", {"keep_acronyms": False}, False),
    ("numerals", {"numerals": "word"}, False),
    ("several settings at once", {"shortest": 1, "stops": {}, "letters": 10}, False),
    ("several rules of tokens at once", {"shortest": 1, "stops": {}, "letters": 10, "keep_acronyms": False, "numerals": "word"}, True),
]


def coverage_cause(short: str, long: str, rules: Rules = Rules()) -> str:
    """Why a long form gives no such short form: search budget when its tokens could, else the first change that helps."""

    def reaches(changes, subsequence):
        r = Rules(**{**{k: getattr(rules, k) for k in rules.__dataclass_fields__}, **changes})
        return representable(short, [t for t in tokens_of(long, r) if t["eligible"] and t["letters"]], r.letters, subsequence)

    if reaches({}, False):
        return "search budget"
    return next((cause for cause, changes, any_ in CAUSES if reaches(changes, any_)), "unrepresentable")


def coverage_causes(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(…, cause) of pairs (…, short, long)."""

    @F.pandas_udf("string")
    def cause(short: pd.Series, long: pd.Series) -> pd.Series:
        return pd.Series([coverage_cause(a or "", b or "", rules) for a, b in zip(short, long, strict=True)])

    return pairs.withColumn("cause", cause("short", "long"))
