"""The interchange schema, its checks, the text tables, and the command line."""

import json

import pytest

from glosswright import __main__ as cli
from glosswright.operators import governed as g
from glosswright.operators import vocabulary as v
from glosswright.sources import results


def test_schema_fits_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.5], {"k": True}), (2, None, [], {})], "id long not null, s string, x array<double>, m map<string, boolean>")
    results.export_schema(rows, str(tmp_path / "s.json"))
    schema = results.load_schema(str(tmp_path / "s.json"))
    assert schema["required"] == ["id"] and schema["properties"]["s"]["type"] == ["string", "null"]
    good = rows.toJSON().collect() if hasattr(rows.toJSON(), "collect") else []
    assert all(not results.problems(json.loads(t), schema) for t in good)
    lines = spark.createDataFrame([('{"id": 1}',), ('{"s": "a"}',), ('{"id": "x"}',), ('{"id": 1, "x": ["y"]}',), ("{",), ('{"id": 1, "extra": 5, "m": {"a": 1}}',)], "value string")
    assert sorted(r["problem"][:12] for r in results.invalid_rows(lines, schema).collect()) == ["$.id: not in", "$.m.a: not b", "$.x[0]: not ", "$: Expecting", "$: no id"]


def test_remote_references_are_refused(tmp_path):
    (tmp_path / "s.json").write_text('{"properties": {"a": {"$ref": "https://example.org/x"}}}')
    with pytest.raises(ValueError):
        results.load_schema(str(tmp_path / "s.json"))


def test_audit_as_text(spark):
    vocab = v.vocabulary(spark, [("CD", "Code", [], None, "class_word_abbrev", True, "Code", "E1", "governed", 1.0)])
    ids = spark.createDataFrame([(1, "X_CD"), (2, "X_CD"), (3, "Y_1")], "id long, identifier string")
    text = results.render_audit(g.Audit(ids, vocab, v.POLICIES["governed_default"]))
    assert "identifiers: 3" in text and "distinct identifiers: 2" in text and "missing_class_word" in text
    assert [line.split() for line in text.splitlines() if line.startswith("X ")] == [["X", "2"]]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("glosswright.session.session", lambda *a, **b: spark)
    (tmp_path / "b.json").write_text(json.dumps({"entries": [{"token": "CD", "canonical": "Code", "keep_as_abbrev": True, "class_word": "Code"}, {"token": "CUST", "canonical": "Customer", "keep_as_abbrev": True}]}))
    (tmp_path / "names.txt").write_text("CUST_CD\nODD_NM\n")
    (tmp_path / "words.txt").write_text("portable\ndocument\nformat\n")
    bundle = ["--bundle", f"file://{tmp_path}/b.json"]

    def run(*args):
        status = cli.main(list(args))
        return status, [json.loads(x) if x.startswith("{") else x for x in capsys.readouterr().out.splitlines()]

    assert run("version") == (0, [cli.VERSION]) and run("doctor")[0] == 0
    assert run("expand-identifier", "CUST_CD", *bundle)[1][0]["logical_name"] == "Customer Code"
    assert run("physical-name", "Customer Code", *bundle)[1][0]["physical"] == "CUST_CD"
    assert run("check-name", "CUST_CD", *bundle)[0] == 0 and run("check-name", "odd_x", *bundle)[0] == 1
    assert run("normalize-name", "cust_cd", *bundle)[1][0]["normalized"] == "CUST_CD"
    assert run("expand-token", "cd", *bundle)[1][0]["long"] == "Code"
    status, rows = run("generate", "Portable Document Format", "--lexicon", f"file://{tmp_path}/words.txt")
    assert status == 0 and rows[0]["candidates"][0]["acronym"] == "PDF"
    assert run("generate", "of the")[0] == 1
    assert run("score", "Portable Document Format", "p.d.f.")[1][0]["acronym"] == "PDF"
    assert run("backronym", "Portable Document Format", "PDF")[1][0]["expansion"] == "Portable Document Format"
    assert run("synthesize", "PDF", "--lexicon", f"file://{tmp_path}/words.txt")[1][0]["expansion"] == "portable document format"
    assert run("extract", "The Portable Document Format (PDF).")[1][0]["long"] == "Portable Document Format"
    assert [t["text"] for t in run("tokens", "a b-c")[1]] == ["a", "b-c"] and len(run("sentences", "One. Two.")[1]) == 2
    status, rows = run("governed-batch", f"file://{tmp_path}/names*", *bundle)
    assert status == 0 and [r["line"] for r in rows] == [1, 2]
    assert run("governed-audit", f"file://{tmp_path}/names.txt", *bundle)[0] == 0
