"""Tokens of texts with exact offsets, classes and the letters that they can lend.

The scan is a kernel over Arrow batches, since it needs offsets, Unicode normal forms and elisions; what is
asked of the tokens afterwards is relational.  `functions.text` has the JVM-only rules for columns of words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SUPPRESSED, TENS, UNITS, stop_rows

#: Scripts whose runs are one token and lend their first character.
CJK = "⺀-⻿々-〇぀-ヿ㄀-ㄯ㄰-㆏ㇰ-ㇿ㐀-䶿一-鿿ꥠ-꥿가-힯豈-﫿\U00020000-\U0002a6df"
#: Words that lose their vowel before an apostrophe.
ELIDED = frozenset(["c", "d", "dall", "dell", "j", "jusqu", "l", "lorsqu", "m", "n", "nell", "presqu", "puisqu", "qu", "quelqu", "quoiqu", "s", "sull", "t", "un"])
#: Ordinals that are not a cardinal and "th".
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}

APOSTROPHES, DASHES = "'’ʼ՚", "‐-―/\\-"
LETTER = rf"(?:(?![{CJK}])[^\W\d_]|\d)"
TOKEN = re.compile(rf"[{CJK}]+|{LETTER}+(?:(?:[{APOSTROPHES}{DASHES}]|(?<=\d)\.(?=\d)){LETTER}+)*")
ALL_CJK = re.compile(rf"[{CJK}]+")
NUMERAL = re.compile(r"\d+(?:\.\d+)*(?:st|nd|rd|th)?", re.IGNORECASE)
COMPOUND = re.compile(rf"[{DASHES}]+")
CASE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
CATEGORIES = ("article", "preposition", "conjunction", "pronoun", "auxiliary")
ROLES = ("content", "function", "numeral", "symbol", "acronym", "unknown")


def normalized(text: str) -> str:
    """The form that words are compared by: compatibility forms composed, case folded, accents kept."""
    return unicodedata.normalize("NFKC", text).casefold()


def without_accents(text: str) -> str:
    """The text without combining marks; its case stays."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


def _classes(word: str) -> str:
    """A stand-in of equal length for the case rules: A, a, 0 for capitals, small letters and digits, . for others."""
    return "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "." for c in word)


def case_parts(word: str) -> list[str]:
    """The parts of a camelCase word: before a capital after a small letter or digit, before the last capital of a
    run that a small letter follows, and around digits."""
    cuts = [0, *(m.start() for m in CASE.finditer(_classes(word))), len(word)]
    return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def compound_parts(word: str) -> list[str]:
    return [p for piece in COMPOUND.split(word) for p in case_parts(piece)]


def looks_like_acronym(word: str) -> bool:
    return len(word) > 1 and any(map(str.isupper, word)) and not any(map(str.islower, word))


def spelled(value: str) -> str | None:
    """The English words of a cardinal or ordinal from 0 to 999, else None."""
    m = re.fullmatch(r"(\d+)(st|nd|rd|th)?", value.strip(), re.IGNORECASE)
    if not m or int(m.group(1)) > 999:
        return None
    hundreds, rest = divmod(int(m.group(1)), 100)
    words = [UNITS[hundreds], "hundred"] if hundreds else []
    if rest or not hundreds:
        words.append(UNITS[rest] if rest < 20 else "-".join([TENS[rest // 10], *([UNITS[rest % 10]] if rest % 10 else [])]))
    if m.group(2):
        head, dash, last = words[-1].rpartition("-")
        words[-1] = head + dash + (ORDINALS.get(last) or (last[:-1] + "ie" if last.endswith("y") else last) + "th")
    return " ".join(words)


@dataclass(frozen=True)
class Rules:
    """How tokens are classed.  Categories of `lending` stop words keep their letters; particle, determiner and
    other never do; `extra` words count as other, `keep` words are no stop words."""

    language: str = "en"
    hyphens: str = "split"
    numerals: str = "digit"
    letters: int = 2
    shortest: int = 2
    keep_acronyms: bool = True
    lending: frozenset[str] = frozenset()
    extra: frozenset[str] = frozenset()
    keep: frozenset[str] = frozenset()
    stops: Mapping[str, str] | None = field(default=None, compare=False)

    def lookup(self) -> dict[str, str]:
        own = {w: c for lang, w, c in stop_rows() if lang == self.language} if self.stops is None else dict(self.stops)
        own = {normalized(w): c for w, c in own.items()} | {normalized(w): "other" for w in self.extra}
        return {w: c for w, c in own.items() if w not in set(map(normalized, self.keep))}

    def suppressed(self) -> frozenset[str]:
        return frozenset(SUPPRESSED) | (frozenset(CATEGORIES) - self.lending)


def elisions(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """The span, cut after each elided word that it begins with."""
    out = []
    while m := re.compile(rf"[^{APOSTROPHES}]+(?=[{APOSTROPHES}].)", re.DOTALL).match(text, start, stop):
        if m.group().casefold() not in ELIDED:
            break
        out.append(m.span())
        start = m.end() + 1
    return [*out, (start, stop)]


def token_spans(text: str) -> list[tuple[int, int]]:
    return [span for m in TOKEN.finditer(text) for span in elisions(text, *m.span())]


def lent(surface: str, parts: list[str], rules: Rules) -> str:
    """Letters of a word: of a compound its parts' initials (split) or its first one (first_only), else the first ones."""
    if len(parts) > 1 and rules.hyphens in ("split", "first_only"):
        initials = [next((c.upper()[:1] for c in p if c.isalpha()), "") for p in parts]
        return initials[0] if rules.hyphens == "first_only" else "".join(initials)[: rules.letters]
    return "".join(c.upper() for c in surface if c.isalpha())[: rules.letters]


def tokens_of(text: str | None, rules: Rules, stops: dict[str, str] | None = None) -> list[dict]:
    """The tokens of a text.  First match: run of a caseless script, numeral, acronym, stop word, content."""
    stops = rules.lookup() if stops is None else stops
    suppressed, out = rules.suppressed(), []
    for index, (a, b) in enumerate(token_spans(text or "")):
        surface = text[a:b]
        key, role, category, eligible, parts = normalized(surface), "content", None, True, []
        if ALL_CJK.fullmatch(surface):
            letters = surface[:1]
        elif NUMERAL.fullmatch(surface):
            role, eligible = "numeral", rules.numerals != "skip"
            digits = "".join(c for c in surface if c.isdigit())
            words = spelled(surface) if rules.numerals == "word" else None
            letters = words[0].upper() if words else digits if eligible else ""
        else:
            parts = compound_parts(surface)
            if rules.keep_acronyms and looks_like_acronym(surface):
                role, letters = "acronym", "".join(c for c in surface if c.isalnum()).upper()
            else:
                letters, category = lent(surface, parts, rules), stops.get(key)
                if category:
                    role, eligible = "function", category not in suppressed
        if role not in ("acronym", "numeral") and len(surface) < rules.shortest:
            eligible = False
        out.append({"text": surface, "normalized": key, "index": index, "start": a, "stop": b, "role": role, "category": category, "critical": role in ("content", "acronym") and eligible, "eligible": eligible, "letters": letters, "subtokens": parts if len(parts) > 1 else []})
    return out


TOKEN_TYPE = "struct<text:string,normalized:string,index:int,start:int,stop:int,role:string,category:string,critical:boolean,eligible:boolean,letters:string,subtokens:array<string>>"
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("normalized", pa.string()), ("index", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("role", pa.string()), ("category", pa.string()), ("critical", pa.bool_()), ("eligible", pa.bool_()), ("letters", pa.string()), ("subtokens", pa.list_(pa.string()))]))


def tokenize(rows: DataFrame, rules: Rules = Rules(), id_column: str = "id", text_column: str = "text") -> DataFrame:
    """(id, text, tokens) of rows: tokens are an array of structs in the order of the text; null texts have none."""
    stops = rules.lookup()

    def run(batches):
        for batch in batches:
            found = [tokens_of(t, rules, stops) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), batch.column("text"), pa.array(found, _ARROW)], ["id", "text", "tokens"])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, text string, tokens array<{TOKEN_TYPE}>")


def token_rows(tokenized: DataFrame) -> DataFrame:
    """(id, token columns): a row for each token."""
    return tokenized.select("id", F.explode("tokens").alias("t")).select("id", "t.*")


def text_key(c: Column) -> Column:
    """normalized() of a column, as a vectorized function."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(normalized, na_action="ignore")

    return run(c)


def accentless(c: Column) -> Column:
    """without_accents() of a column, as a vectorized function."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(without_accents, na_action="ignore")

    return run(c)


def suppressed_words(words: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """words (word) with category, is_stop and is_suppressed under the rules; a join with the list of stop words."""
    known = words.sparkSession.createDataFrame(sorted(rules.lookup().items()), "low string, category string")
    barred = F.col("category").isin(sorted(rules.suppressed()))
    rows = words.withColumn("low", F.lower("word")).join(F.broadcast(known), "low", "left")  # a list of stop words
    return rows.select("word", "category", F.col("category").isNotNull().alias("is_stop"), F.coalesce(barred, F.lit(False)).alias("is_suppressed"))
