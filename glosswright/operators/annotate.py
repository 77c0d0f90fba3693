"""Parts of speech from a tagger, aligned with our own tokens.

A backend is any object with `is_available()` and `annotate(text, tokens)`, which returns annotations
(text, pos, lemma, start, stop).  The built-in one guesses from stop words and suffixes.  Installed taggers
can be passed in; none is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CATEGORY_POS, SUFFIX_POS

#: Universal tags of content and of function words, and the roles that only the tokenizer gives.
CONTENT_POS = frozenset(["NOUN", "PROPN", "VERB", "ADJ", "NUM"])
FUNCTION_POS = frozenset(["DET", "ADP", "CCONJ", "SCONJ", "PRON", "AUX", "PART", "INTJ"])
OWN_ROLES = frozenset(["acronym", "numeral", "symbol"])
#: Universal tags of the Penn Treebank's, by exact tag and by the beginning of others.
PENN = {
    "NN": "NOUN", "NNS": "NOUN", "NNP": "PROPN", "NNPS": "PROPN", "VB": "VERB", "VBD": "VERB", "VBG": "VERB", "VBN": "VERB", "VBP": "VERB", "VBZ": "VERB", "MD": "AUX",
    "JJ": "ADJ", "JJR": "ADJ", "JJS": "ADJ", "RB": "ADV", "RBR": "ADV", "RBS": "ADV", "WRB": "ADV", "IN": "ADP", "DT": "DET", "PDT": "DET", "WDT": "DET", "CC": "CCONJ",
    "PRP": "PRON", "PRP$": "PRON", "WP": "PRON", "WP$": "PRON", "EX": "PRON", "TO": "PART", "RP": "PART", "POS": "PART", "UH": "INTJ", "CD": "NUM", "SYM": "SYM", "$": "SYM", "#": "SYM",
    ".": "PUNCT", ",": "PUNCT", ":": "PUNCT", "``": "PUNCT", "''": "PUNCT", "(": "PUNCT", ")": "PUNCT", "-LRB-": "PUNCT", "-RRB-": "PUNCT", "FW": "X", "LS": "X",
}
PENN_BEGINNINGS = [("NNP", "PROPN"), ("WRB", "ADV"), ("WDT", "DET"), ("PRP", "PRON"), ("NN", "NOUN"), ("VB", "VERB"), ("JJ", "ADJ"), ("RB", "ADV"), ("WP", "PRON")]
#: Annotations that a token looks ahead when there are no offsets.
AHEAD = 8
_SUFFIXES = sorted(((s, tag) for tag, group in SUFFIX_POS.items() for s in group), key=lambda x: (-len(x[0]), x[0]))


class Annotation(NamedTuple):
    text: str
    pos: str | None = None
    lemma: str | None = None
    start: int | None = None
    stop: int | None = None


class Backend(Protocol):
    def is_available(self) -> bool: ...

    def annotate(self, text: str, tokens: Sequence[dict]) -> list[Annotation]: ...


class BackendUnavailable(RuntimeError):
    """The tier asked for needs a tagger that is not there."""


class Heuristic:
    """Guesses tags; it never changes a token's role."""

    changes_roles = False

    def is_available(self) -> bool:
        return True

    def annotate(self, text, tokens):
        def guess(t):
            if t["role"] in ("acronym", "numeral"):
                return {"acronym": "PROPN", "numeral": "NUM"}[t["role"]]
            if t["category"]:
                return CATEGORY_POS[t["category"]]
            low = t["text"].lower()
            return next((tag for s, tag in _SUFFIXES if low.endswith(s) and len(low) >= len(s) + 2), "NOUN")

        return [Annotation(t["text"], guess(t), None, t["start"], t["stop"]) for t in tokens]


def penn_to_universal(tag: str) -> str:
    tag = tag.upper()
    return PENN.get(tag) or next((u for begin, u in PENN_BEGINNINGS if tag.startswith(begin)), "X")


def role_of(token: dict, pos: str) -> str:
    pos = pos.upper()
    if token["role"] in OWN_ROLES:
        return token["role"]
    if pos in CONTENT_POS or pos == "X" and any(map(str.isupper, token["text"])):
        return "content"
    return "function" if pos in FUNCTION_POS else token["role"]


def applied(token: dict, note: Annotation | None, roles: bool = True) -> dict:
    """The token with pos and lemma, and with roles its role and criticality; as it is without a note."""
    out = {"pos": None, "lemma": None} | token
    if note is None:
        return out
    out |= {"pos": note.pos or out["pos"], "lemma": note.lemma or out["lemma"]}
    if roles and note.pos and (role := role_of(token, note.pos)) != token["role"]:
        out |= {"role": role, "critical": role in ("content", "acronym") and token["eligible"]}
    return out


def align_in_order(tokens: Sequence[dict], notes: Sequence[Annotation]) -> list[Annotation | None]:
    """For taggers without offsets: each token takes the next equal surface form among the AHEAD next notes."""
    out, at = [], 0
    for t in tokens:
        near = (k for k in range(at, min(len(notes), at + AHEAD)) if notes[k].text.casefold() == t["text"].casefold())
        hit = next(near, None)
        out.append(None if hit is None else notes[hit])
        at = at if hit is None else hit + 1
    return out


def align_by_offsets(tokens: DataFrame, notes: DataFrame) -> DataFrame:
    """tokens (id, index, start, stop, …) with pos and lemma of notes (id, start, stop, pos, lemma) that overlap them.

    A note of the same span comes first, else the last one with a content tag, else the first one.  The join is on
    the text's id, then by overlap; tokens without a note keep nulls.  Both joins are told to merge: Spark takes rows
    of exploded arrays for as small as the texts' files and would gather them in the driver to broadcast them.
    """
    n = notes.where("start is not null and stop is not null").select("id", F.col("start").alias("a"), F.col("stop").alias("b"), "pos", "lemma")
    met = tokens.select("id", "index", "start", "stop").join(n.hint("merge"), "id").where((F.col("a") < F.col("stop")) & (F.col("b") > F.col("start")))
    same = (F.col("a") == F.col("start")) & (F.col("b") == F.col("stop"))
    head = F.upper(F.coalesce("pos", F.lit(""))).isin(sorted(CONTENT_POS))
    every = Window.partitionBy("id", "index")
    order = F.when(same, F.struct(F.lit(0).alias("k"), F.col("a").alias("x"), F.col("b").alias("y"))).when(head & (F.count("*").over(every) > 1), F.struct(F.lit(1).alias("k"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).otherwise(F.struct(F.lit(2).alias("k"), F.col("a").alias("x"), F.col("b").alias("y")))
    best = met.withColumn("o", order).groupBy("id", "index").agg(F.min_by(F.struct("pos", "lemma"), "o").alias("n"))
    return tokens.drop("pos", "lemma").join(best.hint("merge"), ["id", "index"], "left").withColumns({"pos": F.col("n.pos"), "lemma": F.col("n.lemma")}).drop("n")


def with_roles(tokens: DataFrame) -> DataFrame:
    """tokens with role and critical worked out anew from pos, as columns."""
    pos = F.upper(F.coalesce("pos", F.lit("")))
    content = pos.isin(sorted(CONTENT_POS)) | ((pos == "X") & F.col("text").rlike(r"\p{Lu}"))
    role = F.when(F.col("role").isin(sorted(OWN_ROLES)), F.col("role")).when(content, "content").when(pos.isin(sorted(FUNCTION_POS)), "function").otherwise(F.col("role"))
    critical = F.when(role == F.col("role"), F.col("critical")).otherwise(role.isin("content", "acronym") & F.col("eligible"))
    return tokens.withColumns({"role": role, "critical": critical})


def resolve(tier: str, backends: Sequence[Backend] = (), strict: bool = False) -> tuple[Backend, list[str]]:
    """(backend, warnings) of a tier: zero_dependency, statistical_nlp, hybrid_nlp, neural or auto.

    The first available backend serves all but the first tier; without one, statistical_nlp and strict tiers
    raise, hybrid_nlp and neural fall back to guesses with a warning, auto without.  Neural models are not
    included: that tier warns, or raises when strict.
    """
    warnings = []
    if tier == "zero_dependency":
        return Heuristic(), warnings
    if tier not in ("statistical_nlp", "hybrid_nlp", "neural", "auto"):
        raise ValueError(f"unknown tier {tier!r}")
    if tier == "neural":
        if strict:
            raise BackendUnavailable("neural models are not included")
        warnings.append("neural models are not included; a lower tier is used")
    for b in backends:
        if b.is_available():
            return b, warnings
    if tier == "statistical_nlp" or strict and tier != "auto":
        raise BackendUnavailable(f"tier {tier} needs a tagger")
    if tier != "auto":
        warnings.append("no tagger is available; parts of speech are guessed")
    return Heuristic(), warnings


def annotate(tokenized: DataFrame, backend: Backend) -> DataFrame:
    """(id, token columns, pos, lemma) of tokenize()'s rows by a backend, a batch of texts at a time."""
    from .tokenize import TOKEN_TYPE, token_rows

    roles = getattr(backend, "changes_roles", True)
    kind = tokenized.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, tokens in zip(batch.column("text").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                notes = backend.annotate(text or "", tokens)
                aligned = _by_offsets(tokens, notes) if all(n.start is not None for n in notes) else align_in_order(tokens, notes)
                out.append([applied(t, n, roles) for t, n in zip(tokens, aligned, strict=True)])
            arrow = batch.schema.field("tokens").type.value_type
            fields = [*arrow, pa.field("pos", pa.string()), pa.field("lemma", pa.string())]
            yield pa.record_batch([batch.column("id"), pa.array(out, pa.list_(pa.struct(fields)))], ["id", "tokens"])

    schema = f"id {kind}, tokens array<{TOKEN_TYPE[:-1]},pos:string,lemma:string>>"
    return token_rows(tokenized.mapInArrow(run, schema))


def _by_offsets(tokens, notes):
    """align_by_offsets() for the tokens of one text."""
    out = []
    for t in tokens:
        near = sorted((n for n in notes if n.start < t["stop"] and n.stop > t["start"]), key=lambda n: (n.start, n.stop))
        same = [n for n in near if (n.start, n.stop) == (t["start"], t["stop"])]
        heads = [n for n in near if (n.pos or "").upper() in CONTENT_POS]
        out.append(same[0] if same else None if not near else near[0] if len(near) == 1 or not heads else heads[-1])
    return out
