"""Fitting a target word onto the tokens of a phrase."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phonetics import BigramModel
from .generate import CONTIGUOUS, INITIAL, INTERNAL, PRESETS, UNMAPPED, Weights, mappings, positional, with_scores

OFFSETS = 4


def align(target: str, words: list[str], critical: list[bool], limit: int = 1, alpha: float = 1.0, delta: float = 25.0) -> list[tuple[float, tuple]]:
    """The `limit` best [(score, ((token, offset) or None for each letter))].

    Letters go onto tokens from left to right, on one token at later offsets only; the first OFFSETS places
    of a letter in a token count.  A first letter gains most, one right after the last less, others between;
    a letter without a place and a critical token passed over cost.  A table over (letter, token, offset)
    keeps the best few partial alignments of each cell, so the work is bounded by its size.
    """
    low = [w.lower() for w in words]
    before = [0]
    for c in critical:
        before.append(before[-1] + c)
    # state: (token, offset, joined) -> [(score, path)]
    cells: dict[tuple[int, int, bool], list] = {(-1, -1, False): [(0.0, ())]}
    for letter in target.lower():
        grown: dict[tuple[int, int, bool], list] = {}

        def put(key, score, path, grown=grown):
            grown.setdefault(key, []).append((score, path))

        for (token, offset, joined), partial in cells.items():
            for score, path in partial:
                put((token, offset, False), score - alpha * UNMAPPED, (*path, None))
                for t in range(max(token, 0), len(low)):
                    places = [i for i, c in enumerate(low[t]) if c == letter][:OFFSETS]
                    skipped = delta * (before[t] - before[token + 1]) if t > token else 0.0
                    for o in places:
                        if t == token and o <= offset:
                            continue
                        gain = INITIAL if o == 0 else CONTIGUOUS if joined and t == token and o == offset + 1 else INTERNAL
                        put((t, o, True), score + alpha * gain - skipped, (*path, (t, o)))
        cells = {k: sorted(v, key=lambda x: (-x[0], str(x[1])))[:limit] for k, v in grown.items()}
    done = [(score - delta * (before[-1] - before[token + 1]), path) for (token, _, _), v in cells.items() for score, path in v]
    return sorted(done, key=lambda x: (-round(x[0], 9), str(x[1])))[:limit]


def render(path: tuple, words: list[str]) -> str:
    """The words that an alignment uses, each token once."""
    used = [p[0] for p in path if p]
    return " ".join(words[t] for k, t in enumerate(used) if not k or used[k - 1] != t)


def distinct_alignments(target: str, words: list[str], critical: list[bool], limit: int = 1, alpha: float = 1.0, delta: float = 25.0) -> list[tuple[float, tuple]]:
    """The best alignments, at most one for each text that they render to: score, then coverage, then by path."""
    ask = limit
    while True:
        found = align(target, words, critical, ask, alpha, delta)
        found.sort(key=lambda x: (-round(x[0], 9), -sum(p is not None for p in x[1]), str(x[1])))
        kept: dict[str, tuple] = {}
        for score, path in found:
            kept.setdefault(render(path, words), (score, path))
        if len(kept) >= limit or len(found) < ask:
            return list(kept.values())[:limit]
        ask *= 4


def align_phrases(phrases: DataFrame, limit: int = 1, weights: Weights = PRESETS["strict_initialism"]) -> DataFrame:
    """(id, target, rank, score, expansion, coverage, words_by_letter, unmapped, assigned, loss) of (id, target, words, critical).

    words_by_letter has an entry for each letter, empty where it has no place; assigned its token and offset.
    """
    names = ["id", "target", "rank", "score", "expansion", "coverage", "words_by_letter", "unmapped", "assigned", "loss"]
    place = pa.struct([("token_index", pa.int32()), ("char_offset", pa.int32())])
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(place), pa.int32())

    def run(batches):
        for batch in batches:
            rows = []
            for i, target, words, critical in zip(*(batch.column(c).to_pylist() for c in ("id", "target", "words", "critical")), strict=True):
                letters, words, critical = "".join(c for c in target or "" if c.isalnum()).upper(), words or [], critical or []
                for rank, (score, path) in enumerate(distinct_alignments(letters, words, critical, limit, weights.alpha, weights.delta), 1):
                    by = [words[p[0]] if p else "" for p in path]
                    lost = [c for c, p in zip(letters, path, strict=True) if p is None]
                    loss = sum(c for k, c in enumerate(critical) if k not in {p[0] for p in path if p})
                    rows.append((i, letters, rank, score, render(path, words), sum(p is not None for p in path) / max(1, len(path)), by, lost, [p or (None, None) for p in path], loss))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in names]
            columns[8] = [[{"token_index": t, "char_offset": o} for t, o in x] for x in columns[8]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = "id long, target string, rank int, score double, expansion string, coverage double, words_by_letter array<string>, unmapped array<string>, assigned array<struct<token_index:int,char_offset:int>>, loss int"
    return phrases.select(F.col("id").cast("long").alias("id"), "target", "words", "critical").mapInArrow(run, schema)


def score_given(phrases: DataFrame, weights: Weights, model: BigramModel, lexicon: DataFrame) -> DataFrame:
    """(id, acronym, score, positional, phi, lexical, loss, mappings) of given acronyms (id, target, words, critical).

    The best alignment of the acronym is scored as a generated one is.  Rows whose acronym has no letter or digit
    have no score.
    """
    best = align_phrases(phrases, 1, weights).withColumn("acronym", F.col("target")).where("acronym <> ''")
    best = best.withColumn("mappings", mappings(F.col("acronym"), F.col("assigned"))).withColumn("positional", positional(F.col("mappings")))
    return with_scores(best.drop("score"), weights, model, lexicon).select("id", "acronym", "score", "positional", "phi", "lexical", "loss", "mappings")


def score_aligned(aligned: DataFrame, weights: Weights, model: BigramModel, lexicon: DataFrame) -> DataFrame:
    """align_phrases() rows with the generator's whole score, ranked anew by it, coverage and text."""
    rows = aligned.withColumn("acronym", F.col("target")).where("acronym <> ''")
    rows = rows.withColumn("positional", positional(mappings(F.col("acronym"), F.col("assigned"))))
    rows = with_scores(rows.drop("score", "rank"), weights, model, lexicon)
    order = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), F.desc("coverage"), "expansion")
    return rows.withColumn("rank", F.row_number().over(order)).select("id", "target", "rank", "score", "expansion", "coverage", "words_by_letter", "unmapped")


def score_synthesized(words: DataFrame, targets: DataFrame, weights: Weights, model: BigramModel, lexicon: DataFrame) -> DataFrame:
    """(id, target, rank, score, expansion, coverage, unmapped) of synthesize()'s rows (id, turn, pos, word) and targets (id, target).

    Each word gives its initial and none is lost; equal expansions come once, equal scores in order of turns.
    """
    letters = F.upper(F.regexp_replace("target", r"[^\p{L}\p{N}]", ""))
    per = words.groupBy("id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    rows = per.join(targets.select("id", letters.alias("acronym")), "id")
    n = F.length("acronym")
    held = F.transform("w", lambda x: x["pos"])
    rows = rows.withColumn("expansion", F.array_join(F.transform("w", lambda x: x["word"]), " ")).withColumn("coverage", F.size("w") / n)
    rows = rows.withColumn("unmapped", F.transform(F.array_except(F.sequence(F.lit(0), n - 1), held), lambda k: F.substr(F.col("acronym"), k + 1, F.lit(1))))
    rows = rows.withColumn("positional", F.size("w") * INITIAL - (n - F.size("w")) * UNMAPPED).withColumn("loss", F.lit(0))
    first = rows.groupBy("id", "expansion").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("id", "expansion", "w")]), "turn").alias("r")).select("id", "expansion", "r.*")
    scored = with_scores(first, weights, model, lexicon)
    order = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "turn")
    return scored.withColumn("rank", F.row_number().over(order)).select("id", F.col("acronym").alias("target"), "rank", "score", "expansion", "coverage", "unmapped")
