"""Tokens, numerals and annotations on known texts."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswright.operators import annotate as an
from glosswright.operators import tokenize as tk
from glosswright.operators.vocabulary import literal


def _texts(text, **rules):
    return [t["text"] for t in tk.tokens_of(text, tk.Rules(**rules))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Multi-factor auth, input/output.", ["Multi-factor", "auth", "input/output"]),
        ("don't l'eau qu'il jusqu'alors O'Brien", ["don't", "l", "eau", "qu", "il", "jusqu", "alors", "O'Brien"]),
        ("3.5 1.2.3 v2.0 21st", ["3.5", "1.2.3", "v2.0", "21st"]),
        ("世界卫生 WHO和ok", ["世界卫生", "WHO", "和", "ok"]),
        ("snake_case --x-- 'y'", ["snake", "case", "x", "y"]),
        ("", []),
    ],
)
def test_token_spans(text, want):
    assert _texts(text) == want


@given(st.text(max_size=60))
def test_offsets_are_exact(text):
    tokens = tk.tokens_of(text, tk.Rules())
    assert all(text[t["start"] : t["stop"]] == t["text"] and t["text"] for t in tokens)
    assert all(a["stop"] <= b["start"] for a, b in zip(tokens, tokens[1:], strict=False)) and [t["index"] for t in tokens] == list(range(len(tokens)))


def test_classes():
    got = {t["text"]: t for t in tk.tokens_of("The XMLHttp API of 3 THE a 世界 self-contained", tk.Rules())}
    assert [(got[w]["role"], got[w]["eligible"], got[w]["critical"]) for w in ("The", "API", "3", "THE", "a")] == [("function", False, False), ("acronym", True, True), ("numeral", True, False), ("acronym", True, True), ("function", False, False)]
    assert got["XMLHttp"]["subtokens"] == ["XML", "Http"] and got["XMLHttp"]["letters"] == "XH" and got["世界"]["letters"] == "世"
    assert got["self-contained"]["letters"] == "SC" and got["of"]["category"] == "preposition"
    lends = tk.tokens_of("a day of rest", tk.Rules(lending=frozenset(["preposition"]), extra=frozenset(["Day"]), keep=frozenset(["rest"])))
    assert [(t["text"], t["eligible"]) for t in lends] == [("a", False), ("day", False), ("of", True), ("rest", True)]
    assert tk.tokens_of("self-contained", tk.Rules(hyphens="first_only"))[0]["letters"] == "S" and tk.tokens_of("self-contained", tk.Rules(hyphens="merge", letters=3))[0]["letters"] == "SEL"
    assert [tk.tokens_of("21st", tk.Rules(numerals=n))[0]["letters"] for n in ("digit", "word", "skip")] == ["21", "T", ""]


@pytest.mark.parametrize(("word", "want"), [("XMLHttpRequest", ["XML", "Http", "Request"]), ("iOS", ["i", "OS"]), ("parseJSON", ["parse", "JSON"]), ("abc123Def", ["abc", "123", "Def"]), ("don't", ["don't"]), ("ÉtatÉté", ["État", "Été"]), ("", [])])
def test_case_parts(word, want):
    assert tk.case_parts(word) == want


def test_spelled_and_forms():
    assert [tk.spelled(x) for x in ("0", "7", "1st", "21st", "40th", "100th", "312", "999th", "1000", "3.5", "x")] == ["zero", "seven", "first", "twenty-first", "fortieth", "one hundredth", "three hundred twelve", "nine hundred ninety-ninth", None, None, None]
    assert tk.normalized("ＡＢＣ Straße É") == "abc strasse é" and tk.without_accents("Résumé Über ß") == "Resume Uber ß"


def test_alignment_and_tiers():
    tokens = tk.tokens_of("The input/output of NASA ran", tk.Rules())
    notes = [an.Annotation("The", "DET"), an.Annotation("input", "NOUN"), an.Annotation("of", "ADP"), an.Annotation("nasa", "PROPN"), an.Annotation("ran", "VERB", "run")]
    assert [n and n.text for n in an.align_in_order(tokens, notes)] == ["The", None, "of", "nasa", "ran"]
    spans = [an.Annotation("input", "NOUN", None, 4, 9), an.Annotation("/", "SYM", None, 9, 10), an.Annotation("output", "ADP", None, 10, 16)]
    assert an._by_offsets(tokens[1:2], spans)[0].text == "input"
    ran = an.applied(tokens[4], notes[4])
    assert ran["lemma"] == "run" and ran["role"] == "content" and an.applied(tokens[1], an.Annotation("x", "ADP"))["critical"] is False
    assert an.applied(tokens[3], an.Annotation("x", "ADP"))["role"] == "acronym"
    for tier in ("statistical_nlp",):
        with pytest.raises(an.BackendUnavailable):
            an.resolve(tier)
    with pytest.raises(an.BackendUnavailable):
        an.resolve("neural", [an.Heuristic()], strict=True)
    assert an.resolve("hybrid_nlp")[1] and not an.resolve("auto")[1] and len(an.resolve("neural")[1]) == 2


class Words:
    """A tagger without offsets."""

    def is_available(self):
        return True

    def annotate(self, text, tokens):
        return [an.Annotation(w, "VERB" if w == "of" else None, w.lower()) for w in text.split()]


def test_a_passed_backend(spark):
    rows = tk.tokenize(spark.createDataFrame([(1, "Text of NASA"), (2, None)], "id long, text string"))
    got = [(r["text"], r["role"], r["pos"], r["lemma"]) for r in an.annotate(rows, Words()).orderBy("index").collect()]
    assert got == [("Text", "content", None, "text"), ("of", "content", "VERB", "of"), ("NASA", "acronym", None, "nasa")]


def test_aligned_tokens_are_not_broadcast(spark):
    """The estimate of exploded tokens is that of their texts: below the threshold, whatever they really take."""
    rows = tk.token_rows(tk.tokenize(literal(spark, [(1, "a bc"), (2, "def")], "id long, text string")))
    notes = rows.select("id", "start", "stop", F.lit("NOUN").alias("pos"), F.lit("x").alias("lemma"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = an.align_by_offsets(rows, notes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
