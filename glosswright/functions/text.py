"""Column functions over words: tokens, classes, letters, numerals, parts of speech.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal numbers, or word characters with inner apostrophes, hyphens and slashes.
WORD = r"\d+(?:\.\d+)+|[\p{L}\p{N}]+(?:['’/\-][\p{L}\p{N}]+)*"
NUMERAL = r"^\d+(\.\d+)*(st|nd|rd|th|ST|ND|RD|TH)?$"
ROMAN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"

#: Function words by category and language: lists of our own.
STOP_WORDS = {
    "en": {
        "article": "a an the",
        "preposition": "of in on at by for with from to into onto over under between among through during against about",
        "conjunction": "and or but nor so yet because although while if unless",
        "pronoun": "i you he she it we they me him her us them who which that this these those",
        "auxiliary": "is are was were be been being am do does did has have had will would can could shall should may might must",
        "determiner": "each every some any no all both either neither",
        "particle": "not as than then there",
        "other": "very just also",
    },
    "fr": {
        "article": "le la les un une des du l",
        "preposition": "de à en dans par pour sur avec sans sous entre chez vers",
        "conjunction": "et ou mais donc or ni car que si",
        "pronoun": "je tu il elle nous vous ils elles qui on se ce",
        "auxiliary": "est sont était être avoir a ont fait",
        "determiner": "cette ces son sa ses leur leurs",
        "particle": "ne pas plus",
        "other": "très aussi",
    },
    "de": {
        "article": "der die das den dem des ein eine einer eines",
        "preposition": "von zu in an auf mit bei nach aus für über unter",
        "conjunction": "und oder aber denn sondern dass weil",
        "pronoun": "ich du er sie es wir ihr sich wer was",
        "auxiliary": "ist sind war waren sein haben hat wird werden",
        "determiner": "jeder jede dieser diese dieses kein keine",
        "particle": "nicht auch nur",
        "other": "sehr schon",
    },
    "es": {
        "article": "el la los las un una unos unas",
        "preposition": "de en a por para con sin sobre entre desde hasta",
        "conjunction": "y o pero ni que porque si",
        "pronoun": "yo tú él ella nosotros ellos ellas se lo le",
        "auxiliary": "es son era ser estar ha han fue",
        "determiner": "este esta estos estas cada todo",
        "particle": "no al del",
        "other": "muy más también",
    },
}
#: Categories that never lend letters; the others are switches of the configuration.
SUPPRESSED = ("particle", "determiner", "other")

#: Suffixes and the universal part of speech that each suggests.
SUFFIX_POS = {
    "NOUN": ["tion", "sion", "ment", "ness", "ance", "ence", "ship", "ity", "ism", "ist", "er", "or"],
    "VERB": ["ing", "ate", "ify", "ise", "ize", "ed"],
    "ADJ": ["able", "ible", "less", "ous", "ive", "ful", "al", "ic"],
    "ADV": ["ly"],
}
#: Universal part of speech of a function word's category.
CATEGORY_POS = {"article": "DET", "determiner": "DET", "preposition": "ADP", "conjunction": "CCONJ", "pronoun": "PRON", "auxiliary": "AUX", "particle": "PART", "other": "X"}
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def stop_rows() -> list[tuple[str, str, str]]:
    """(language, word, category), each word of a language once, in its first category."""
    out = {}
    for language, by in STOP_WORDS.items():
        for category, words in by.items():
            for w in words.split():
                out.setdefault((language, w), category)
    return [(a, b, c) for (a, b), c in out.items()]


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def is_all_caps(c: Column) -> Column:
    """At least two characters, a capital, no lower-case letter."""
    return (F.length(c) >= 2) & c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def is_roman(c: Column) -> Column:
    return (c != "") & F.upper(c).rlike(ROMAN)


def role(token: Column, category: Column) -> Column:
    """First match: numeral, acronym (all capitals, even of a stop word), function word, content."""
    return F.when(token.rlike(NUMERAL), "numeral").when(is_all_caps(token), "acronym").when(category.isNotNull(), "function").otherwise("content")


def heuristic_pos(token: Column, category: Column) -> Column:
    """Acronyms and numerals, then the stop-word class, then the longest suffix with a stem of two, else NOUN."""
    out = F.when(token.rlike(NUMERAL), "NUM").when(is_all_caps(token), "PROPN")
    for name, tag in CATEGORY_POS.items():
        out = out.when(category == name, tag)
    low = F.lower(token)
    for suffix, tag in sorted(((s, tag) for tag, group in SUFFIX_POS.items() for s in group), key=lambda x: (-len(x[0]), x[0])):
        out = out.when(low.endswith(suffix) & (F.length(token) >= len(suffix) + 2), tag)
    return out.otherwise("NOUN")


def cardinal(n: Column) -> Column:
    """Words for 0..999, null beyond."""
    units, tens = F.array(*map(F.lit, UNITS)), F.array(*map(F.lit, TENS))

    def below_hundred(x):
        two = F.element_at(tens, (x / 10).cast("int") + 1)
        return F.when(x < 20, F.element_at(units, x + 1)).otherwise(F.when(x % 10 == 0, two).otherwise(F.concat(two, F.lit("-"), F.element_at(units, x % 10 + 1))))

    n = n.cast("int")
    safe = F.when(n.between(0, 999), n)
    head = F.concat(F.element_at(units, (safe / 100).cast("int") + 1), F.lit(" hundred"))
    rest = below_hundred(safe % 100)
    return F.when(safe < 100, rest).when(safe % 100 == 0, head).when(safe.isNotNull(), F.concat(head, F.lit(" "), rest))


def donated_letters(surface: Column, policy: str = "merge", limit: int = 1) -> Column:
    """Letters that a word lends: of a hyphen compound by policy (split, merge, first_only), else its first ones."""
    parts = F.filter(F.split(surface, r"[-‐‑–/]"), lambda x: x != "")
    letters = F.upper(F.regexp_replace(surface, r"[^\p{L}]", ""))
    if policy == "merge":
        return F.substring(letters, 1, limit)
    initials = F.transform(parts, lambda x: F.upper(F.substring(F.regexp_replace(x, r"[^\p{L}]", ""), 1, 1)))
    taken = F.slice(initials, 1, 1 if policy == "first_only" else limit)
    return F.when(F.size(parts) > 1, F.array_join(taken, "")).otherwise(F.substring(letters, 1, limit))


def numeral_letters(surface: Column, policy: str = "digit") -> Column:
    if policy == "skip":
        return F.lit("")
    digits = F.regexp_replace(surface, r"\D", "")
    return digits if policy == "digit" else F.upper(F.substring(cardinal(digits.cast("int")), 1, 1))


def apply_case(c: Column, style: str) -> Column:
    return {"upper": F.upper(c), "lower": F.lower(c), "title": F.initcap(c), "preserve": c}[style]


def language_of(tag: Column) -> Column:
    return F.element_at(F.split(F.lower(tag), "[-_]"), 1)
