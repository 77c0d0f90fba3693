"""Toxicity by a weighted finite-state grammar over clauses.

A text is read as a tape: each of its words becomes one symbol - a level of insult (a..h, the learned weight), a
threat verb, a target, a negation, a reporting word or any other word - and the ends of clauses and sentences
and quotation marks are symbols too.  Five transducers read the tape, each with a transition table of its own:

* negation: marks the SCOPE words after a negation, to the end of the clause;
* reported speech: marks what follows a reporting word in the sentence, and what stands in quotation marks;
* target: remembers whether the clause has named one;
* insult: an insult without marks makes the clause a match; its arc has the insult's weight;
* threat: a threat verb without marks and a target within REACH words of it, in either order, make a match.

They are composed, in this order, into one automaton: the marks that one writes are read by the next.  A clause
is a path through it, whose weight is the sum of its arcs; the state in which it ends says whether it matched,
and whether it named a target.  A logistic model over the weights of the matched clauses gives the score, so
words that match no clause add nothing.

Learned from labelled rows only: insult patterns and their weights (words, and beginnings of words for forms
not seen), targets and negations beside the listed ones (words that insults keep company with in toxic, and in
clean texts), and the coefficients.  The sample is bounded by SAMPLE rows, those with the smallest hash of
their identifier; equal texts of it count once.  Everything learned is a function of the rows alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, text_bytes, trim, written

SAMPLE, LEVELS = 16_000, 8
LEAST_DOCS, LEAST_WEIGHT, PREFIXES = 5, 2.0, (4, 5, 6, 7, 8)
#: Words that a negation covers, and words between a threat verb and its target.
SCOPE, REACH = 3, 4
#: Cues: texts in which they stand with insults, by which factor more than elsewhere, and how many standard errors.
CUE_TEXTS, CUE_FACTOR, CUE_ERRORS = 8, 3.0, 4.0

#: A small lexicon of its own for rows far from the labels.
INSULTS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "vermin", "filth", "scumbag"]
THREATS = ["kill", "hurt", "destroy", "attack", "beat", "shoot", "stab", "strangle", "burn", "punish"]
TARGETS = ["you", "your", "yours", "he", "she", "they", "him", "her", "them", "u", "ur", "tu", "vous", "toi", "du", "dich", "ihr", "sie", "usted", "ustedes", "this", "these", "those"]
NEGATIONS = ["not", "no", "never", "nobody", "nothing", "without", "cannot", "don't", "isn't", "aren't", "wasn't", "won't", "doesn't", "didn't", "pas", "jamais", "nicht", "nie", "kein", "keine", "nunca", "jamás"]
REPORTS = ["said", "says", "say", "wrote", "writes", "claimed", "claims", "called", "calls", "quoted", "quote", "reported", "reports", "according", "dit", "sagte", "sagt", "dijo", "dice"]

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
OTHER, CLAUSE, SENTENCE, TARGET, NEGATION, REPORT, OPEN, CLOSE, THREAT = "_,.TNRQqH"
INSULT = "abcdefgh"
SYMBOLS = [OTHER, CLAUSE, SENTENCE, TARGET, NEGATION, REPORT, OPEN, CLOSE, THREAT, *INSULT]
ENDS, SILENT = CLAUSE + SENTENCE, CLAUSE + SENTENCE + OPEN + CLOSE
MATCH = re.compile("[a-hH]")

Marks = frozenset
NONE: Marks = frozenset()


class Transducer:
    """A transition table {(state, symbol, marks): (state, marks)} over all reachable states and the marks given."""

    def __init__(self, start, marks: list[str], step: Callable):
        self.start, self.table = start, {}
        given = [frozenset(m for k, m in enumerate(marks) if i >> k & 1) for i in range(1 << len(marks))]
        todo = [start]
        for state in todo:
            for a in SYMBOLS:
                for m in given:
                    after, wrote = step(state, a, m)
                    self.table[state, a, m] = after, m | wrote
                    if after not in todo:
                        todo.append(after)


def _negation(left: int, a: str, _):
    if a in SILENT:
        return (0 if a in ENDS else left), NONE
    return (SCOPE if a == NEGATION else max(0, left - 1)), frozenset(["negated"] if left else [])


def _reported(state: tuple[bool, bool], a: str, _):
    told, quoted = state
    after = (a == REPORT or told and a != SENTENCE, a == OPEN or quoted and a not in (CLOSE, SENTENCE))
    return after, frozenset(["reported"] if (told or quoted) and a not in SILENT else [])


def _target(seen: bool, a: str, _):
    if a in ENDS:
        return False, frozenset(["aimed"] if seen else [])
    return seen or a == TARGET, NONE


def _insult(matched: bool, a: str, m: Marks):
    if a in ENDS:
        return False, frozenset(["insulting"] if matched else [])
    return matched or a in INSULT and not m, NONE


def _threat(state: tuple, a: str, m: Marks):
    kind, left = state  # "", "verb", "target" with the words left to meet the other, "match"
    if a in ENDS:
        return ("", 0), frozenset(["threatening"] if kind == "match" else [])
    if kind == "match" or a in SILENT:
        return state, NONE
    verb, target = a == THREAT and not m, a == TARGET
    if verb and kind == "target" or target and kind == "verb":
        return ("match", 0), NONE
    if verb or target:
        return ("verb" if verb else "target", REACH), NONE
    return (kind, left - 1) if left > 1 else ("", 0), NONE


TRANSDUCERS = [
    Transducer(0, [], _negation),
    Transducer((False, False), ["negated"], _reported),
    Transducer(False, ["negated", "reported"], _target),
    Transducer(False, ["negated", "reported", "aimed"], _insult),
    Transducer(("", 0), ["negated", "reported", "aimed", "insulting"], _threat),
]


def compose(parts: list[Transducer]) -> tuple[list[dict], int]:
    """The product automaton, states numbered as they are reached: [{symbol: (state, marks)}] and the start."""
    start = tuple(t.start for t in parts)
    number, todo, arcs = {start: 0}, [start], []
    for states in todo:
        out = {}
        for a in SYMBOLS:
            marks, after = NONE, []
            for t, s in zip(parts, states, strict=True):
                s, marks = t.table[s, a, marks]
                after.append(s)
            after = tuple(after)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            out[a] = number[after], marks
        arcs.append(out)
    return arcs, 0


#: Where the weight of an arc goes.
PLAIN, NEGATED, REPORTED = range(3)


def weighted(arcs: list[dict]) -> list[dict]:
    """[{symbol: (state, kind, weight)}] for arcs of insults, {symbol: (state, marks, 0)} at clause ends, else (state, None, 0)."""
    out = []
    for by in arcs:
        row = {}
        for a, (after, marks) in by.items():
            if a in INSULT:
                row[a] = after, (NEGATED if "negated" in marks else REPORTED if "reported" in marks else PLAIN), (INSULT.index(a) + 1) / LEVELS
            elif a in ENDS:
                row[a] = after, (marks & {"aimed", "insulting", "threatening"}), 0.0
            else:
                row[a] = after, None, 0.0
        out.append(row)
    return out


AUTOMATON = weighted(compose(TRANSDUCERS)[0])
FEATURES = ["insulting", "strongest", "aimed", "negated", "reported", "threatening"]


def path_weights(tape: str) -> list[float]:
    """The features of a tape: log1p of the summed weights of its matched clauses, and of what was marked; the strongest clause."""
    insulting = strongest = aimed = negated = reported = threatening = 0.0
    for sentence in tape.split(SENTENCE):
        if not MATCH.search(sentence):
            continue
        state, mass = 0, [0.0, 0.0, 0.0]
        for a in sentence + SENTENCE:
            state, kind, weight = AUTOMATON[state][a]
            if kind is None:
                continue
            if weight:
                mass[kind] += weight
                continue
            negated += mass[NEGATED]
            reported += mass[REPORTED]
            if "insulting" in kind:
                insulting += mass[PLAIN]
                strongest = max(strongest, mass[PLAIN])
                if "aimed" in kind:
                    aimed += mass[PLAIN]
            if "threatening" in kind:
                threatening += 1
            mass = [0.0, 0.0, 0.0]
    return [np.log1p(insulting), min(strongest, 2.0), np.log1p(aimed), np.log1p(negated), np.log1p(reported), np.log1p(threatening)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=lambda: {w: 4.0 for w in INSULTS})
    cues: dict[str, str] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 2.0, 1.0, 0.5, 0.0, 0.0, 1.0])
    center: list[float] = field(default_factory=lambda: [0.0] * 6)
    scale: list[float] = field(default_factory=lambda: [1.0] * 6)


class Grammar:
    """Reads texts as tapes; remembers what it has read short pieces as, a bounded number of them."""

    KEPT, SHORT = 50_000, 64

    def __init__(self, model: Model):
        self.weights = model.weights
        self.top = max([LEAST_WEIGHT, *self.weights.values()])
        self.sign = {}
        for letter, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.sign |= dict.fromkeys(words, letter)
        self.sign |= model.cues
        self.seen: dict[bytes, str] = {}

    def weight(self, word: str) -> float:
        w = self.weights.get(word)
        if w is None:
            for n in reversed(PREFIXES):
                if len(word) > n and (w := self.weights.get(word[:n] + "*")) is not None:
                    break
        return w or 0.0

    def symbol(self, word: str) -> str:
        w = self.weight(word)
        return INSULT[min(LEVELS - 1, int(LEVELS * w / self.top))] if w > 0 else self.sign.get(word, OTHER)

    def read(self, piece: bytes) -> str:
        text = piece.decode("utf-8", "replace").lower()
        out = [OPEN] if text[:1] in "\"“«" and len(text) > 1 else []
        out += map(self.symbol, WORD.findall(text))
        if text[-1:] in "\"”»" and len(text) > 1:
            out.append(CLOSE)
        if tail := re.search(r"[.,;:!?]+[\"”»')\]]*$", text):
            out.append(SENTENCE if re.search("[.!?]", tail.group()) else CLAUSE)
        return "".join(out)

    def tape(self, text: bytes | None) -> str:
        if len(self.seen) > self.KEPT:
            self.seen = {}
        seen, out = self.seen, []
        for piece in (text or b"").split():
            got = seen.get(piece)
            if got is None:
                got = self.read(piece)
                if len(piece) <= self.SHORT:
                    seen[piece] = got
            out.append(got)
        return "".join(out)

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """(n, 6) in the order of FEATURES; all zero for texts without a match."""
        out = np.zeros((len(texts), len(FEATURES)))
        for i, text in enumerate(texts):
            tape = self.tape(text)
            if MATCH.search(tape):
                out[i] = path_weights(tape)
        return out

    def company(self, text: bytes) -> tuple[list[str], list[str]]:
        """The words of clauses with an insult, and those of the others; insults themselves are left out."""
        near, far, clause, hit = [], [], [], False
        for piece in text.split():
            words = WORD.findall(piece.decode("utf-8", "replace").lower())
            for w in words:
                if self.weight(w) > 0:
                    hit = True
                else:
                    clause.append(w)
            if piece[-1:] in b".,;:!?":
                (near if hit else far).extend(clause)
                clause, hit = [], False
        (near if hit else far).extend(clause)
        return near, far


def score(features: np.ndarray, model: Model) -> np.ndarray:
    x = (features - np.array(model.center)) / np.array(model.scale)
    z = x @ np.array(model.coefficients[1:]) + model.coefficients[0]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    center, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.hstack([np.ones((len(x), 1)), (x - center) / scale])
    b = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist(), center.tolist(), scale.tolist()


def _counted(texts: DataFrame, key: str, names: list[str], count: Callable) -> DataFrame:
    """Sums by key over all texts of what count(text, y) yields: (key, numbers)."""

    def run(batches):
        lean()
        sums: dict[str, list[int]] = {}

        def flush():
            rows = list(sums.items())
            sums.clear()
            return pa.record_batch([pa.array([k for k, _ in rows], pa.string()), *(pa.array([v[j] for _, v in rows], pa.int64()) for j in range(len(names)))], [key, *names])

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for k, j, n in count(text, y):
                    sums.setdefault(k, [0] * len(names))[j] += n
                if len(sums) > 200_000:
                    yield flush()
        if sums:
            yield flush()
        trim()

    schema = f"{key} string, " + ", ".join(f"{n} long" for n in names)
    return texts.mapInArrow(run, schema).groupBy(key).agg(*(F.sum(n).alias(n) for n in names))


def _patterns(text: bytes, y: int):
    words = {m for piece in set(text.split()) for m in WORD.findall(piece.decode("utf-8", "replace").lower())}
    for p in words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}:
        yield p, y, 1


def learn_cues(texts: DataFrame, weights: dict[str, float]) -> dict[str, str]:
    """Words that keep company with insults: targets where texts are toxic, negations where they are clean.

    A cue stands in clauses with an insult in at least CUE_TEXTS texts, CUE_FACTOR times as often for each word
    there as in the other clauses of the texts of its label, and CUE_ERRORS standard errors above an even share.
    """

    def company(text, y):
        near, far = grammar().company(text)
        for side, words in enumerate((near, far)):
            for w in words:
                yield w, 3 * y + side, 1
            yield "", 3 * y + side, len(words)
        for w in set(near):
            yield w, 3 * y + 2, 1

    made: list[Grammar] = []

    def grammar():
        if not made:
            made.append(Grammar(Model(weights=weights)))
        return made[0]

    counted = written(_counted(texts, "word", [f"{label}_{side}" for label in ("clean", "toxic") for side in ("near", "far", "texts")], company), "company")
    rows = counted.where(F.expr(f"word = '' or toxic_texts >= {CUE_TEXTS} or clean_texts >= {CUE_TEXTS}")).collect()  # words of insults' clauses
    total = next((r for r in rows if r["word"] == ""), None)
    cues = {}
    for r in sorted((r for r in rows if r["word"]), key=lambda r: r["word"]):
        for letter, label in ((NEGATION, "clean"), (TARGET, "toxic")):
            near, far = r[f"{label}_near"], r[f"{label}_far"]
            if r[f"{label}_texts"] >= CUE_TEXTS:
                all_near, all_far = total[f"{label}_near"] + 1, total[f"{label}_far"] + 1
                even = (near + far) * all_near / (all_near + all_far)  # if it stood anywhere alike
                if near / all_near >= CUE_FACTOR * (far + 0.5) / all_far and near - even >= CUE_ERRORS * np.sqrt(even + 1):
                    cues[r["word"]] = letter
    return cues


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on labelled rows whose crc32 of the identifier's digits, modulo 4, is not 2.

    An identifier labelled twice has its larger label; equal texts with one label count once; null texts are
    empty.  With no toxic or no clean row in the sample the built-in lexicon is used.
    """
    small_batches(docs.sparkSession)
    ident = F.col(id_column).cast("long")
    usable = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).where(~held_out(id_column))
    picked = usable.groupBy(ident.alias("doc_id")).agg(F.max((F.col(label_column) > 0).cast("int")).alias("y"))
    sample = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # SAMPLE rows of two numbers
    rows = docs.select(ident.alias("doc_id"), text_bytes(text_column).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = written(rows.groupBy(F.sha2("text", 256).alias("sha"), "y").agg(F.first("text").alias("text")).select("text", "y"), "sample")
    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    model = Model()
    if not n.get(0) or not n.get(1):
        return model
    counted = _counted(texts, "pattern", ["clean", "toxic"], _patterns)
    weight = F.log((F.col("toxic") + 0.5) / n[1]) - F.log((F.col("clean") + 0.5) / n[0])
    # a smoothed log odds; built-in words keep a weight unless the labels deny it.  Each pattern takes LEAST_DOCS texts of the sample
    found = counted.where(F.col("toxic") >= LEAST_DOCS).select("pattern", weight.alias("w")).where(F.col("w") >= LEAST_WEIGHT).collect()
    model.weights |= {r["pattern"]: r["w"] for r in sorted(found, key=lambda r: r["pattern"])}
    model.cues = {w: c for w, c in learn_cues(texts, model.weights).items() if w not in model.weights}
    packed = json.dumps(asdict(model))

    def examples(batches):
        lean()
        g = Grammar(Model(**json.loads(packed)))
        for batch in batches:
            f = g.features(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("y"), *(pa.array(f[:, k]) for k in range(6))], ["y", *(f"f{k}" for k in range(6))])

    keys = ["y", *(f"f{k}" for k in range(6))]
    got = sorted(tuple(r) for r in texts.mapInArrow(examples, "y int, " + ", ".join(f"f{k} double" for k in range(6))).groupBy(*keys).agg(F.count("*").alias("n")).collect())  # at most SAMPLE rows
    x = np.repeat(np.array([r[1:7] for r in got]), [r[7] for r in got], axis=0)
    y = np.repeat(np.array([float(r[0]) for r in got]), [r[7] for r in got])
    model.coefficients, model.center, model.scale = fit_logistic(x, y)
    return model


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.col(id_column).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: Model, cut: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone, in narrow tasks.

    Null and empty texts score as texts without a match; null identifiers are not held out.
    """
    small_batches(docs.sparkSession)
    packed = json.dumps(asdict(model))  # bounded by the sample

    def run(batches):
        lean()
        m = Model(**json.loads(packed))
        g = Grammar(m)
        for batch in batches:
            s = score(g.features(batch.column("text").to_pylist()), m)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        del g
        trim()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), text_bytes(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, cut: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of docs whose score is below the cut, all columns as they are."""
    small_batches(docs.sparkSession)
    packed = json.dumps(asdict(model))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lean()
        m = Model(**json.loads(packed))
        g = Grammar(m)
        for texts in parts:
            yield pd.Series(score(g.features(texts.tolist()), m))
        del g
        trim()

    return docs.where(scored(text_bytes(text_column)) < cut)
