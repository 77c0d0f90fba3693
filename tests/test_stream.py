"""The line stream: shapes of lines, numbers, errors as records."""

import json

import pytest

from glosswright.operators import vocabulary as v
from glosswright.streaming import lines

LINES = ["CUST_CD", "", '{"identifier": "ACCT_CD", "id": 7}', '{"identifier": "X", "id": "a"}', "{broken", '{"id": 3}', '{"identifier": 5}', '{"identifier": "Y", "id": {"a": 1}}', "  ", " padded_cd "]


@pytest.fixture(scope="module")
def vocab(spark):
    return v.vocabulary(spark, [("CD", "Code", [], None, "class_word_abbrev", True, "Code", "E1", "governed", 1.0), ("CUST", "Customer", [], None, "approved_abbrev", True, None, "E2", "governed", 1.0)])


def _run(spark, vocab, tmp_path, verb, policy):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(LINES) + "\n")
    lines.run(lines.read_lines(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", vocab, policy, verb).awaitTermination()
    out = spark.read.schema("line long, id string, input string, ok boolean, result string, error string, error_type string").json(f"file://{tmp_path}/out")
    return out, {r["line"]: r for r in out.collect()}


def test_expand(spark, vocab, tmp_path):
    out, rows = _run(spark, vocab, tmp_path, "expand", v.POLICIES["governed_default"])
    assert sorted(rows) == [1, 3, 4, 5, 6, 7, 8, 10]
    assert json.loads(rows[1]["result"])["logical_name"] == "Customer Code" and rows[1]["id"] is None
    assert rows[3]["id"] == "7" and rows[4]["id"] == '"a"' and rows[10]["input"] == "padded_cd"
    assert [rows[k]["ok"] for k in (5, 6, 7, 8)] == [False] * 4 and rows[6]["id"] == "3" and rows[8]["id"] is None
    assert {rows[k]["error_type"] for k in (5, 6, 7, 8)} == {"InputError"}
    text = [json.loads(r["value"]) for r in lines.record(out).collect()]
    assert all(list(t)[0] == "line" and ("result" in t) == t["ok"] for t in text)


def test_reject_is_an_error_of_its_line(spark, vocab, tmp_path):
    _, rows = _run(spark, vocab, tmp_path, "normalize", v.POLICIES["governed_default"].but(unknown="reject"))
    assert rows[1]["ok"] and json.loads(rows[1]["result"]) == {"name": "CUST_CD", "normalized": "CUST_CD"}
    assert rows[3]["error"] == "unknown token ACCT" and rows[3]["error_type"] == "LexiconError"


def test_numbers_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"n{k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = spark.read.text(f"file://{tmp_path}/a.txt").selectExpr("value", "_metadata.file_path as file", "_metadata.file_block_start as split")
        got = lines.numbered(rows).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(r["value"] == f"n{r['line'] - 1}" for r in got)


def test_unknown_verb(spark, vocab):
    with pytest.raises(ValueError):
        lines.run(None, "", "", vocab, v.POLICIES["governed_default"], "shout")
