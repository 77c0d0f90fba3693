"""Each stage of the pipeline against brute force on its own input, and the whole run."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from glosswright.llm import toxicity
from glosswright.llm.common import written

from .test_operators import WORD_FILE, _crc, _ids, _jaccard, odd  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(written(stage(spark, out[-1], DATA), f"test{k}"))
    return out


def _rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxicity_rejects_what_scores(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = toxicity.score_documents(stages[0], toxicity.train(stages[0], labels)).collect()
    assert set(_rows(stages[1])) == {r["doc_id"] for r in scored if not r["predicted"]}


def test_exact(stages):
    best = {}
    for i, r in _rows(stages[1]).items():
        key = re.sub("[\x20\x09-\x0d]", "", r["text"] or "")
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r["text"] or ""), i))
    assert set(_rows(stages[2])) == {i for _, i in best.values()}


def test_near(stages):
    before = [(i, r["text"]) for i, r in _rows(stages[2]).items()]
    assert set(_rows(stages[3])) == {i for i, _, c in _jaccard(before, 5, 80) if i == c}


def test_repeats(stages):
    before, after, first = _rows(stages[3]), _rows(stages[4]), {}
    for i in sorted(before):
        b = (before[i]["text"] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert after[i]["text"] == kept and after[i]["n_chars"] == len(kept)
        assert after[i]["lang"] == before[i]["lang"] and after[i]["source"] == before[i]["source"]


def test_packing_and_run(spark, stages):
    texts = [(i, r["text"]) for i, r in _rows(stages[4]).items()]
    want = Counter()
    for (i, _), ids in zip(texts, _ids(WORD_FILE, [t for _, t in texts]), strict=True):
        ids = [*ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[(i, k, at, len(ids[at : at + 4096]), _crc(ids[at : at + 4096]))] += 1
    for df in (stages[5], corpus_pipeline.run(spark, DATA)):
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect()) == want


def test_stages_on_odd_and_no_rows(spark, odd):  # noqa: F811
    for df in (odd, odd.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, DATA)
            rows = out.collect()
            assert k + 1 == len(corpus_pipeline.STAGES) or out.columns == df.columns
            assert bool(rows) == bool(df.count())
