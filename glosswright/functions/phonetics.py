"""Sound of words: vowels, syllables, runs, and a character bigram model trained from a lexicon."""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_VOWEL, CONSONANT_RUN, LONGEST_RUN, NEUTRAL = 0.35, 0.6, 3, 0.5


def has_vowel(w: Column) -> Column:
    return F.lower(w).rlike("[aeiouy]")


def vowel_ratio(w: Column) -> Column:
    letters = F.length(F.regexp_replace(F.lower(w), "[^a-z]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(F.lower(w), "[^aeiouy]", "")) / letters).otherwise(0.0)


def syllables(w: Column) -> Column:
    """Vowel runs, less a silent final e (after a consonant, not in -le), at least one."""
    low = F.lower(w)
    runs = F.size(F.regexp_extract_all(low, F.lit("[aeiouy]+"), F.lit(0)))
    silent = low.rlike("[^aeiouy]e$") & ~low.endswith("le") & (F.length(w) > 2)
    return F.greatest(runs - silent.cast("int"), F.lit(1))


def consonant_run(w: Column) -> Column:
    """Length of the longest run of consonants."""
    runs = F.transform(F.regexp_extract_all(F.lower(w), F.lit("[b-df-hj-np-tv-xz]+"), F.lit(0)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def _framed(lexicon: DataFrame) -> DataFrame:
    """(prev, next, n): counts of the bigrams of words framed by ^ and $."""
    framed = F.concat(F.lit("^"), F.lower("word"), F.lit("$"))
    pairs = lexicon.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(framed, i, F.lit(2)))).alias("p"))
    return pairs.groupBy(F.substring("p", 1, 1).alias("prev"), F.substring("p", 2, 1).alias("next")).agg(F.count("*").alias("n"))


def train_bigrams(lexicon: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """(prev, next, log_prob): add-k bigrams over words framed by ^ and $, dense over the alphabet seen."""
    counts = _framed(lexicon)
    letters = counts.select(F.col("next").alias("c")).where("c <> '$'").distinct()
    sizes = letters.agg((F.count("*") + 2).alias("v"))
    contexts = letters.select(F.col("c").alias("prev")).union(letters.sparkSession.sql("SELECT '^' AS prev"))
    ends = letters.select(F.col("c").alias("next")).union(letters.sparkSession.sql("SELECT '$' AS next"))
    total = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    dense = contexts.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(sizes)).join(counts, ["prev", "next"], "left").join(total, "prev", "left")  # alphabet x alphabet
    top = F.coalesce("n", F.lit(0)) + smoothing
    return dense.select("prev", "next", F.log(top / (F.coalesce("total", F.lit(0)) + smoothing * F.col("v"))).alias("log_prob"))


@dataclass(frozen=True)
class BigramModel:
    """log P(next | prev) of a trained model, and the value of pairs outside it.

    `uniform` ones know no pair: every value is the floor, and pronounceability starts from the neutral 0.5.
    """

    log_probs: dict[str, float]
    low: float
    language: str = "en"
    uniform: bool = False

    def column(self, pair: Column) -> Column:
        """The value of a pair: a place in a literal array where the alphabet lies close together, else a map's."""
        if not self.log_probs:
            return F.lit(self.low)
        codes = sorted({ord(c) for k in self.log_probs for c in k} - {36})
        low, n = codes[0] - 1, codes[-1] - codes[0] + 2  # $ takes the place before the first
        if n > 200:
            table = F.map_from_arrays(F.array(*map(F.lit, self.log_probs)), F.array(*map(F.lit, self.log_probs.values())))
            return F.coalesce(F.try_element_at(table, pair), F.lit(self.low))
        cells = [self.low] * (n * n)
        for k, v in self.log_probs.items():
            x, y = (0 if c == "$" else ord(c) - low for c in k)
            cells[x * n + y] = v

        def place(c: Column) -> Column:
            code = F.when(c == "$", low).otherwise(F.ascii(c)) - low
            return F.when(code.between(0, n - 1), code)

        return F.coalesce(F.get(F.array(*map(F.lit, cells)), place(F.substring(pair, 1, 1)) * n + place(F.substring(pair, 2, 1))), F.lit(self.low))

    def to_json(self) -> str:
        return json.dumps({"language": self.language, "order": 2, "backoff_log_prob": self.low, "uniform": self.uniform, "log_probs": self.log_probs}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> BigramModel:
        """Of to_json(), or with the pairs nested by context under `bigrams` or `log_probs`."""
        raw = json.loads(text)
        pairs = raw.get("log_probs", raw.get("bigrams"))
        if not isinstance(pairs, dict) or "backoff_log_prob" not in raw or raw.get("order", 2) != 2:
            raise ValueError("not a bigram model")
        flat = {}
        for k, v in pairs.items():
            flat.update({k + n: float(x) for n, x in v.items()} if isinstance(v, dict) else {k: float(v)})
        return cls(flat, float(raw["backoff_log_prob"]), raw.get("language", "en"), bool(raw.get("uniform", False)))

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json(), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> BigramModel:
        return cls.from_json(Path(path).read_text(encoding="utf-8"))


def uniform_model(language: str = "en", alphabet: int = 26) -> BigramModel:
    """A model that prefers no pair."""
    return BigramModel({}, -math.log(alphabet + 1), language, True)


def fit_bigrams(lexicon: DataFrame, smoothing: float = 0.5, language: str = "en") -> BigramModel:
    """train_bigrams() with its floor in one pass over the lexicon; the counts are at most the square of an alphabet, checked."""
    rows = _framed(lexicon).limit(40_001).collect()
    if len(rows) > 40_000:
        raise ValueError("the alphabet is too large for a literal model; join train_bigrams() instead")
    count = {r["prev"] + r["next"]: r["n"] for r in rows}
    letters = sorted({k[1] for k in count} - {"$"})
    v, total = len(letters) + 2, Counter()
    for k, n in count.items():
        total[k[0]] += n
    log_probs = {a + b: math.log((count.get(a + b, 0) + smoothing) / (total[a] + smoothing * v)) for a in [*letters, "^"] for b in [*letters, "$"]}
    return BigramModel(log_probs if count else {}, math.log(smoothing) - math.log(max(total.values(), default=0) + smoothing * v), language)


def _mean(text: Column, model: BigramModel, terms: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: model.column(F.substr(text, i, F.lit(2))))
    return F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b) / terms


def phi(w: Column, model: BigramModel) -> Column:
    """Mean bigram log-probability; words of under two characters get the floor."""
    return F.when(F.length(w) < 2, F.lit(model.low)).otherwise(_mean(F.lower(w), model, F.length(w) - 1))


def phi_framed(w: Column, model: BigramModel) -> Column:
    """Mean bigram log-probability with both ends of the word; empty words get the floor."""
    framed = F.concat(F.lit("^"), F.lower(w), F.lit("$"))
    return F.when(F.length(w) < 1, F.lit(model.low)).otherwise(_mean(framed, model, F.length(w) + 1))


def pronounceability(w: Column, model: BigramModel) -> Column:
    """0..1: the mean with both ends rescaled by the floor (0.5 without a model), less for no vowel or a long consonant run."""
    base = F.lit(NEUTRAL) if model.uniform else F.least(F.greatest((phi_framed(w, model) - model.low) / F.lit(-model.low), F.lit(0.0)), F.lit(1.0))
    return base * F.when(has_vowel(w), 1.0).otherwise(NO_VOWEL) * F.when(consonant_run(w) > LONGEST_RUN, CONSONANT_RUN).otherwise(1.0)


def lexicon_of(texts: DataFrame, column: str = "text", least: int = 1) -> DataFrame:
    """(word, n): distinct lower-case ASCII words of a corpus that it holds at least `least` times."""
    rows = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
