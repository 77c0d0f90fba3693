"""Bundles: folders and single objects, sections, pins, overlays and what is refused."""

import json

import pytest

from glosswright.operators.vocabulary import POLICIES
from glosswright.sources import bundles, readers

CATALOG = {"entries": [{"token": "txn", "canonical": "Transaction", "keep_as_abbrev": True}, {"token": "ID", "canonical": "Identifier", "candidates": ["Identifier", "Idaho"], "kind": "ambiguous_pinned"}]}
ALLOW = {"_note": "x", "approved_abbreviations": ["API"], "short_full_words": ["OLD"]}
CLASSES = {"abbreviations": {"CD": "Code", "_x": "y"}, "other": 1}
PINS = {"ID": {"candidates": ["Identifier", "Idaho"], "_pin": "Identifier"}, "NEW": {"candidates": ["Newer", "News"]}, "_about": "x"}
TERMS = "logical_name,term_id\nTransaction  Code,T1\n,T2\nTransaction Code,T3\n"


def _answers(vocab):
    return {r["token"]: (r["long"], r["source"]) for r in vocab.resolved(POLICIES["governed_default"]).collect()}


def test_folder_and_object_agree(spark, tmp_path):
    folder = tmp_path / "b"
    folder.mkdir()
    for name, x in (("dictionary", CATALOG), ("allowlist", ALLOW), ("class_words", CLASSES), ("ambiguity_pins", PINS)):
        (folder / f"{name}.json").write_text(json.dumps(x))
    (folder / "term_glossary.csv").write_text("\ufeff" + TERMS)
    one = bundles.load_bundle(spark, f"file://{folder}", [{"TXN": "Trade"}, {"TXN": {"canonical": "Transfer", "entry_id": "X1", "confidence": 0.5}, "B": " "}])
    got = _answers(one)
    assert got["TXN"] == ("Transfer", "custom") and got["ID"] == ("Identifier", "pinned") and got["NEW"][1] == "scored" and got["API"] == ("Api", "approved") and "B" not in got
    assert [tuple(r)[:2] for r in one.terms.collect()] == [("Transaction Code", "T3")] and {r["token"] for r in one.class_words().collect()} == {"CD", "CODE"}
    (tmp_path / "b.json").write_text(json.dumps({**CATALOG, **ALLOW, "class_words": {"CD": "Code"}, "pins": PINS, "term_index": {"Transaction Code": "T3"}}))
    two = bundles.load_bundle(spark, f"file://{tmp_path}/b.json")
    assert _answers(two) == {**got, "TXN": ("Transaction", "approved")}


@pytest.mark.parametrize(
    "sections",
    [
        {"unrelated": 1},
        {"catalog": [{"token": "A"}]},
        {"catalog": [{"token": "A", "canonical": "B", "odd": 1}]},
        {"catalog": {"rows": []}},
        {"catalog": [{"token": "A", "canonical": "B", "confidence": 2}]},
        {"allowlist": {"common_keywords": "A"}},
        {"class_words": {"CD": 1}},
        {"terms": {"x": 1}},
        {"catalog": [{"token": "A", "canonical": "B", "pin": "C"}], "pins": {"A": {"_pin": "D"}}},
    ],
)
def test_refused(spark, tmp_path, sections):
    (tmp_path / "b.json").write_text(json.dumps(sections))
    with pytest.raises(bundles.BundleError):
        bundles.load_bundle(spark, f"file://{tmp_path}/b.json")


def test_two_files_for_a_section(spark, tmp_path):
    for name in ("dictionary", "catalog"):
        (tmp_path / f"{name}.json").write_text("[]")
    with pytest.raises(bundles.BundleError):
        bundles.load_bundle(spark, f"file://{tmp_path}")
    with pytest.raises(bundles.BundleError):
        bundles.load_bundle(spark, f"file://{tmp_path}/nothing")


def test_csv_catalogs(spark, tmp_path):
    (tmp_path / "c.csv").write_text("\ufeffShort;Long\nid;Identifier\nID;Identity\n;x\n")
    assert [tuple(r) for r in readers.catalog_csv(spark, f"file://{tmp_path}/c.csv", "Short", "Long", ";").collect()] == [("ID", "Identity")]
    (tmp_path / "l.csv").write_text("Long,Short\nIdentification,ID\nIdentifier,ID\nTransaction,TX\nTransaction,TXN\n")
    got = {r["token"]: r for r in readers.long_to_short_csv(spark, f"file://{tmp_path}/l.csv", "Long", "Short").collect()}
    assert set(got) == {"ID", "TXN"} and got["ID"]["candidates"] == ["Identification", "Identifier"] and got["ID"]["canonical"] == "Identifier" and got["ID"]["source"] == "scored"


def test_corpora_and_tables(spark, tmp_path):
    (tmp_path / "t.conll").write_text("The DT B-O\nWHO NN B-AC\n\nOK UH B-O\n")
    rows = sorted((r["uid"][-1], r["idx"], r["token"], r["pos_tag"], r["tag"]) for r in readers.tagged_sentences(spark, f"file://{tmp_path}/t.conll").collect())
    assert rows == [("0", 0, "The", "DT", "B-O"), ("0", 1, "WHO", "NN", "B-AC"), ("1", 0, "OK", "UH", "B-O")]
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "tokens": ["the", "WHO"], "acronym": 1, "expansion": "World Health"}]))
    assert [(r["key"], r["context"]) for r in readers.ambiguous_instances(spark, f"file://{tmp_path}/a.json").collect()] == [("WHO", "the WHO")]
    (tmp_path / "g.json").write_text(json.dumps([{"uid": "1", "text": "t", "pairs": [{"short_form": "A", "long_form": "b"}]}]))
    assert readers.gold_documents(spark, f"file://{tmp_path}/g.json").first()["pairs"][0]["long_form"] == "b"
    (tmp_path / "m.txt").write_text("123\nA text about\n\nportable things (PT).\n  PT|portable things|x\n# note\n456\nNo pairs here.\n")
    got = [(r["identifier"], r["text"], [tuple(p) for p in r["pairs"]]) for r in readers.gold_blocks(spark, f"file://{tmp_path}/m.txt").orderBy("uid").collect()]
    assert got == [("123", "A text about portable things (PT).", [("PT", "portable things")]), ("456", "No pairs here.", [])]
    table = spark.createDataFrame([("al:3", "s", 0.5, 7)], "grp string, strategy string, precision double, support long")
    for name in ("p.json", "p.parquet"):
        readers.save_precision_table(table, f"file://{tmp_path}/{name}")
        assert readers.precision_table(spark, f"file://{tmp_path}/{name}").collect() == table.collect()
