"""Kernels against brute force and known answers."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from glosswright.functions import identifiers as fi
from glosswright.operators import extract as ex
from glosswright.operators import reliability as rel
from glosswright.operators.backronym import OFFSETS, align
from glosswright.operators.generate import CONTIGUOUS, INITIAL, INTERNAL, UNMAPPED
from glosswright.operators.vocabulary import Policy, literal, merge_pins


def test_identifiers(spark):
    rows = [("TXN1STApplntNum21st_XMLHttp",), ("dw.a-b/c",), ("x#y$",), ("",), (None,), ("ABCDef",)]
    got = literal(spark, rows, "identifier string").select(fi.split_identifier(F.col("identifier")).alias("t"), fi.unaccounted(F.col("identifier")).alias("u")).collect()
    assert got[0]["t"] == ["TXN", "1", "ST", "Applnt", "Num", "21st", "XML", "Http"]
    assert got[1]["t"] == ["dw", "a", "b", "c"] and got[1]["u"] == []
    assert got[2]["u"] == ["#", "$"]
    assert got[3]["t"] == [] and got[4]["t"] == []
    assert got[5]["t"] == ["ABC", "Def"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("The Portable Document Format (PDF) is old.", [("PDF", "Portable Document Format")]),
        ("We use PDF (Portable Document Format) here.", [("PDF", "Portable Document Format")]),
        ("See Figure 3 (left) and nothing else.", []),
        ("Nested (the World Health Organization (WHO)) text.", [("WHO", "World Health Organization")]),
        ("Unbalanced (PDF and [x)", []),
        ("", []),
    ],
)
def test_definitions(text, want):
    assert [d[:2] for d in ex.definitions(text)] == want


def test_nested_brackets_stay_linear():
    assert ex.definitions("(" * 5000 + ")" * 5000) == []


def _score(path, words, critical, delta=25.0):
    score, token, offset, joined, jumped = 0.0, -1, -1, False, 0
    for p in path:
        if p is None:
            score, joined = score - UNMAPPED, False
            continue
        t, o = p
        if t < max(token, 0) or (t == token and o <= offset):
            return None
        if t > token:
            jumped += sum(critical[token + 1 : t])
        score += INITIAL if o == 0 else CONTIGUOUS if joined and t == token and o == offset + 1 else INTERNAL
        token, offset, joined = t, o, True
    return score - delta * (jumped + sum(critical[token + 1 :]))


@pytest.mark.parametrize("target,words", [("rab", ["red", "apple", "bun"]), ("eel", ["steel", "eel"]), ("xo", ["box"]), ("ana", ["banana", "nan"])])
def test_alignment_is_the_best(target, words):
    critical = [True] * len(words)
    places = [[None] + [(t, o) for t, w in enumerate(words) for o in [i for i, c in enumerate(w) if c == x][:OFFSETS]] for x in target]
    best = max(s for path in product(*places) if (s := _score(path, words, critical)) is not None)
    got = align(target, words, critical, limit=2)
    assert got[0][0] == pytest.approx(best)
    assert all(_score(p, words, critical) == pytest.approx(s) for s, p in got)


def test_strategies():
    assert len(rel.STRATEGIES) == 30
    by = {s[0]: s for s in rel.STRATEGIES}
    assert rel.matches("PDF", ["portable", "document", "format"], by["start_initial_none"])
    assert not rel.matches("PDF", ["portable", "and", "document", "format"], by["start_initial_none"])
    assert rel.matches("PDF", ["portable", "and", "document", "format"], by["start_initial_stop"])
    assert rel.matches("PDFs", ["portable", "document", "format"], by["start_initial_none_plural"])
    assert rel.best_start("DF", ["document", "document", "format"], by["start_initial_none"]) == 1


def test_policy_and_pins(spark):
    with pytest.raises(ValueError):
        Policy(mode="odd")
    catalog = literal(spark, [("A", "Alpha", ["Alpha", "Alp"], "Alpha")], "token string, canonical string, candidates array<string>, pin string")
    pins = literal(spark, [("A", ["Alpha", "Alp"], "Alp")], "token string, candidates array<string>, pin string")
    with pytest.raises(Exception, match="contradicting"):
        merge_pins(catalog, pins).collect()
