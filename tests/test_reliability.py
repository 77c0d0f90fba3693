"""Strategy hits, the cascade and the re-ranking against loops over the collected rows."""

import random

import pytest

from glosswright.operators import reliability as rel
from glosswright.operators.vocabulary import literal

TEXTS = [
    (1, "We saw the World Health Organization (WHO) and a portable document format (PDF)."),
    (2, "mice as models of Nuclear Factor kappa (NFk) then heat shock proteins (HSPs) rose"),
    (3, "nothing (of note) here (ZZ)"),
    (4, "department of defense (DoD), self contained underwater breathing (SCUB)"),
    (5, ""),
    (6, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return rel.harvest(literal(spark, TEXTS, "doc_id long, text string"))


def _table(spark):
    values = [(g, s[0], round(1.0 / (2 + (7 * k) % 11), 4), 5 + k % 3) for g in ("al:3", "al:4", "al:2", "al:5", "spec:5") for k, s in enumerate(rel.STRATEGIES)]
    return literal(spark, values, "grp string, strategy string, precision double, support long"), {(g, s): p for g, s, p, _ in values}


def _group(short):
    kind = "al" if short.isalpha() else "num" if short.isalnum() else "spec"
    return f"{kind}:{min(5, len(short))}"


def test_strategies():
    assert len(rel.STRATEGIES) == 30 and "as" in rel.STOPS and len(rel.STOPS) == 16
    hit = lambda s, w: {x[0] for x in rel.STRATEGIES if rel.matches(s, w.split(), x)}
    assert "start_initial_stop" in hit("DAD", "Data as Dates") and "start_initial_none" not in hit("DAD", "Data of Art Dates")


def test_hits(spark, rows):
    for r in rel.strategy_hits(rows).collect():
        assert r["hit"] == [s[0] for s in rel.STRATEGIES if any(rel.matches(r["short"], r["words"][k:], s) for k in range(len(r["words"])))]


@pytest.mark.parametrize("minimum", [0.0, 0.3])
def test_cascade(spark, rows, minimum):
    table, precision = _table(spark)
    want = {}
    for r in rows.collect():
        tried = sorted((-precision[_group(r["short"]), s[0]], k, s[0], s) for k, s in enumerate(rel.STRATEGIES) if (_group(r["short"]), s[0]) in precision and precision[_group(r["short"]), s[0]] >= minimum)
        for _, _, _, s in tried:
            start = rel.best_start(r["short"], r["words"], s)
            if start is not None:
                want[r["doc_id"], r["ord"]] = (" ".join(r["words"][start:]), s[0])
                break
    assert {(r["doc_id"], r["ord"]): (r["long"], r["strategy"]) for r in rel.long_forms(rows, table, minimum).collect()} == want


@pytest.mark.parametrize("minimum", [0.0, 0.3])
def test_reranked(spark, rows, minimum):
    table, precision = _table(spark)
    want = {}
    for r in rows.collect():
        best = (0.0, "")
        for k in reversed(range(len(r["words"]))):
            words = r["words"][k:]
            value = max((precision.get((_group(r["short"]), s[0]), 0.0) for s in rel.STRATEGIES if rel.best_start(r["short"], words, s) is not None), default=0.0)
            if value > best[0]:
                best = (value, " ".join(words))
        if best[0] > 0 and best[0] >= minimum:
            want[r["doc_id"], r["ord"]] = (best[1], best[0])
    assert {(r["doc_id"], r["ord"]): (r["long"], r["score"]) for r in rel.reranked(rows, table, minimum).collect()} == want


def test_latest_starts_of_all_strategies():
    rng = random.Random(5)
    stop = sorted(rel.STOPS)
    for _ in range(4_000):
        words = [rng.choice(stop) if rng.random() < 0.3 else "".join(rng.choices("abcsS", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 7))]
        short = "".join(rng.choices("abcsSt ", k=rng.randint(0, 5)))
        want = {s[0]: k for s in rel.STRATEGIES if (k := rel.best_start(short, words, s)) is not None}
        assert rel.latest_starts(short, words) == want, (short, words)


def test_reranking_tries_each_bracket_once(spark, rows, monkeypatch):
    """Every span before a bracket went through the kernel, some six times the work of the longest one."""
    table, _ = _table(spark)
    tried, starts = [], rel.strategy_starts
    monkeypatch.setattr(rel, "strategy_starts", lambda r: (tried.append(r.count()), starts(r))[1])
    rel.reranked(rows, table).collect()
    assert tried == [rows.count()]
