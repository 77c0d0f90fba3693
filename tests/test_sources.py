import json

import pytest

from glosswright.sources import readers


def test_catalog(spark, tmp_path):
    entry = {"token": "cd", "canonical": "Code", "candidates": ["Code"], "kind": "class_word_abbrev"}
    for k, doc in enumerate(({"entries": [entry]}, [entry])):
        (tmp_path / f"c{k}.json").write_text(json.dumps(doc))
        rows = readers.catalog_json(spark, str(tmp_path / f"c{k}.json")).collect()
        assert [(r["token"], r["canonical"]) for r in rows] == [("CD", "Code")]
    (tmp_path / "bad.json").write_text(json.dumps({"entries": [entry, {"token": "x"}]}))
    with pytest.raises(Exception, match="position 1"):
        readers.catalog_json(spark, str(tmp_path / "bad.json")).collect()


def test_csv_and_terms(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿logical_name,term_id\nFoo  Bar,1\nfoo bar,2\n,3\n", encoding="utf-8")
    rows = readers.term_index(spark, str(tmp_path / "t.csv")).collect()
    assert [r["term_id"] for r in rows] == ["2"]
    with pytest.raises(ValueError):
        readers.pairs_csv(spark, str(tmp_path / "t.csv"), "nothing", "term_id")


def test_lexicon_stops_dictionary(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Apple # fruit\n\n# only\npear\napple\n")
    assert sorted(r["word"] for r in readers.lexicon_text(spark, str(tmp_path / "l.txt")).collect()) == ["apple", "pear"]
    (tmp_path / "s.json").write_text(json.dumps({"categories": {"article": ["The", "a"]}}))
    assert sorted(tuple(r) for r in readers.stop_words_json(spark, str(tmp_path / "s.json")).collect()) == [("article", "a"), ("article", "the")]
    (tmp_path / "n.json").write_text(json.dumps({"_about": "x", "pronoun": ["We"], "article": ["a"]}))
    assert sorted(tuple(r) for r in readers.stop_words_json(spark, str(tmp_path / "n.json")).collect()) == [("article", "a"), ("pronoun", "we")]
    (tmp_path / "f.json").write_text(json.dumps(["The", "a", " "]))
    assert sorted(tuple(r) for r in readers.stop_words_json(spark, str(tmp_path / "f.json")).collect()) == [("other", "a"), ("other", "the")]
    (tmp_path / "d.json").write_text(json.dumps({"PDF": ["Portable Document Format", "Probability Density Function"]}))
    assert readers.dictionary_json(spark, str(tmp_path / "d.json")).count() == 2
