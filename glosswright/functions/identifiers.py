"""Column functions over identifiers: splitting, qualifiers, case forms.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDINAL = r"\d+(?:st|nd|rd|th|ST|ND|RD|TH|St|Nd|Rd|Th)(?![\p{L}\p{Nd}])"
#: Runs of digits, capitals before a capital that begins a word, and words with at most one capital in front.
TOKEN = rf"{ORDINAL}|\d+|[\p{{Lu}}\p{{Lt}}]+(?![\p{{Ll}}])[\p{{Lo}}\p{{Lm}}]*|[\p{{Lu}}\p{{Lt}}]?[\p{{Ll}}\p{{Lo}}\p{{Lm}}]+"
#: Characters that part an identifier and are not reported.
SEPARATOR = r"_\-./\\'\"`\[\]\s"


def split_identifier(c: Column) -> Column:
    """Surface tokens in order: separators vanish, camel and digit boundaries cut, ordinals stay whole."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def unaccounted(c: Column) -> Column:
    """Characters that are neither letters, digits nor separators, one entry for each occurrence."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"[^\p{{L}}\p{{Nd}}{SEPARATOR}]"), F.lit(0))


def strip_qualifier(c: Column) -> Column:
    """The last segment of a dotted name that is not blank; null when there is none."""
    return F.element_at(F.filter(F.split(c, r"\."), lambda x: F.trim(x) != ""), -1)


def split_camel_case(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d+|[\p{Lu}]+(?![\p{Ll}])|[\p{Lu}]?[\p{Ll}]+"), F.lit(0))


def is_upper_snake(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[\p{Lu}\p{Lo}\p{Lt}\p{Nd}]+(_[\p{Lu}\p{Lo}\p{Lt}\p{Nd}]+)*$"), F.lit(False))


def title_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def phrase_key(c: Column) -> Column:
    """Case-folded with white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


#: Words that look inflected and are not, and state names, exempt or charged as a naming standard does.
PAST_TENSE_NOUNS = [
    "expedited", "approved", "expired", "defaulted", "secured", "ranked", "sealed", "shared",
]
SINGULAR_PLURALS = [
    "address", "savings", "securities", "stats", "ops", "alias", "status", "process", "access", "business", "class",
]
STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi",
    "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming",
]


def canonical_form_score(candidate: Column, token: Column) -> Column:
    """Penalty of a long form for a token; the lowest wins a collision, ties by text."""
    text = F.trim(F.regexp_replace(candidate, r"\s+", " "))
    low = F.lower(text)
    last = F.element_at(F.split(low, " "), -1)

    def charge(points, condition):
        return F.when(condition, F.lit(float(points))).otherwise(F.lit(0.0))

    return (
        charge(100, F.trim(token).rlike(r"^\p{L}{2}$") & low.isin(STATES))
        + charge(50, low.endswith("ing"))
        + charge(40, low.endswith("ly"))
        + charge(30, low.endswith("ed") & ~last.isin(PAST_TENSE_NOUNS))
        + charge(20, low.endswith("s") & ~last.isin(SINGULAR_PLURALS))
        + charge(10, text.contains(" "))
        + F.length(text).cast("double")
    )
