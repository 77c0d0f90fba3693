"""A whole governed standard from a folder of files or one JSON object, through Spark's file systems.

Discovery and the checks of shape run on the driver: a standard is a handful of vocabulary files.  Every
section may be absent; a bundle without any is an error, and so are two files for one section.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import SparkSession

from ..operators.vocabulary import CATALOG_SCHEMA, OVERLAY_SCHEMA, Vocabulary, literal

#: Names of files and keys by section, in the order in which they are looked for.
FILES = {
    "catalog": (["dictionary", "catalog", "entries"], [".json"]),
    "allow_lists": (["allowlist", "allowlists", "allow_lists"], [".json"]),
    "class_words": (["class_words", "classwords"], [".json"]),
    "pins": (["ambiguity_pins", "pins"], [".json"]),
    "terms": (["term_glossary", "terms", "glossary"], [".csv", ".json"]),
}
KEYS = {
    "catalog": ["catalog", "dictionary", "entries"],
    "allow_lists": ["allowlist", "allowlists", "allow_lists"],
    "class_words": ["class_words", "classwords"],
    "pins": ["ambiguity_pins", "pins"],
    "terms": ["term_index", "term_glossary", "terms", "glossary"],
}
ALLOW_LISTS = ["approved_abbreviations", "common_keywords", "short_full_words"]
KINDS = ["class_word_abbrev", "approved_abbrev", "unapproved_expansion", "ambiguous_pinned", "short_full_word", "proper_noun_acronym", "domain_pin", "passthrough"]
FIELDS = [f.split()[0] for f in CATALOG_SCHEMA.split(", ")][1:]


class BundleError(ValueError):
    """A file or section that cannot be read as what it should be."""


def _listing(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Names and paths of the files in a folder; None for a file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise BundleError(f"{path} does not exist")
    if not fs.getFileStatus(hadoop).isDirectory():
        return None
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(hadoop) if s.isFile()}


def _text(spark: SparkSession, path: str, encoding: str = "utf-8-sig") -> str:
    data = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    try:
        return bytes(data).decode(encoding)
    except UnicodeDecodeError as e:
        raise BundleError(f"{path}: {e}") from e


def _parsed(spark: SparkSession, path: str) -> Any:
    try:
        return json.loads(_text(spark, path))
    except json.JSONDecodeError as e:
        raise BundleError(f"{path}: {e}") from e


def public(document: Any, what: str) -> dict[str, Any]:
    """The items of an object whose keys do not begin with an underscore."""
    if not isinstance(document, Mapping):
        raise BundleError(f"{what} must be a JSON object, not {type(document).__name__}")
    return {k: x for k, x in document.items() if not k.startswith("_")}


def strings(document: Any, what: str) -> dict[str, str]:
    out = public(document, what)
    for k, x in out.items():
        if not isinstance(x, str):
            raise BundleError(f"{what}: {k!r} must map to a string, not {type(x).__name__}")
    return out


def allow_rows(document: Any) -> list[tuple[str, str]]:
    """(list, token) of the three allow-lists; absent ones are empty."""
    document, out = public(document, "the allow-list section"), []
    for name in ALLOW_LISTS:
        tokens = document.get(name) or []
        if not isinstance(tokens, list) or not all(isinstance(x, str) for x in tokens):
            raise BundleError(f"{name} must be an array of tokens")
        out += [(name, x) for x in tokens]
    return out


def class_rows(document: Any) -> list[tuple[str, str]]:
    """(abbreviation, full form), of the map itself or of one under `abbreviations`."""
    document = public(document, "the class-word map")
    nested = document.get("abbreviations")
    return list(strings(nested if isinstance(nested, Mapping) else document, "the class-word map").items())


def entry(row: Any, position: Any, token: str | None = None) -> tuple:
    """A catalog row (without its number) with the defaults of absent fields; bad ones are named by position."""
    row = public(row, f"catalog row {position}") | ({"token": token} if token else {})
    unknown = set(row) - set(FIELDS) - {"notes"}
    text = {k: row.get(k) for k in ("token", "canonical")}
    if unknown or any(not isinstance(x, str) or not x.strip() for x in text.values()):
        raise BundleError(f"catalog row {position}: " + (f"unknown fields {sorted(unknown)}" if unknown else "token and canonical must be texts"))
    candidates, kind, sure = row.get("candidates") or [], row.get("kind") or "approved_abbrev", row.get("confidence", 1.0)
    if not isinstance(candidates, list) or kind not in KINDS or not isinstance(sure, (int, float)) or not 0 <= sure <= 1:
        raise BundleError(f"catalog row {position}: candidates, kind or confidence are not valid")
    return (text["token"].strip().upper(), " ".join(text["canonical"].split()), candidates, row.get("pin"), kind, bool(row.get("keep_as_abbrev", False)), row.get("class_word"), row.get("entry_id"), row.get("source") or "governed", float(sure))


def catalog_rows(document: Any) -> list[tuple]:
    rows = document.get("entries") if isinstance(document, Mapping) else document
    if not isinstance(rows, list):
        raise BundleError("a catalog must be an array of rows, or an object with one under entries")
    return [entry(r, i) for i, r in enumerate(rows)]


def overlay_rows(custom: Mapping[str, Any], layer: int = 0) -> list[tuple]:
    """Rows of OVERLAY_SCHEMA of {token: long form or whole entry}; blank long forms are dropped."""
    out = []
    for token, value in custom.items():
        if isinstance(value, Mapping):
            if not str(value.get("canonical") or "").strip():
                continue
            e = entry(value, repr(token), token)
            out.append((layer, e[0], e[1], e[7], e[9], e[4], e[5], e[6], e[2]))
        elif " ".join(str(value).split()):
            out.append((layer, token.strip().upper(), " ".join(str(value).split()), None, 1.0, "approved_abbrev", False, None, []))
    return out


def with_pins(rows: list[tuple], sheet: Any) -> list[tuple]:
    """Catalog rows with a pin sheet {token: {candidates, _pin}} merged in.

    Missing pins and candidates are filled, never overwritten; pins or sets of candidates that contradict each
    other are an error; tokens without a row get one, pinned or scored at 0.5.
    """
    by = {r[0]: r for r in rows}
    for token, value in public(sheet, "the pin sheet").items():
        key = token.strip().upper()
        value = value if isinstance(value, Mapping) else {"candidates": value}
        pin, candidates = value.get("_pin", value.get("pin")), value.get("candidates") or []
        r = by.get(key)
        if r is None:
            first = pin or (candidates or [None])[0]
            if first:
                by[key] = (key, first, candidates, pin, "ambiguous_pinned", False, None, None, "pinned" if pin else "scored", 1.0 if pin else 0.5)
            continue
        if r[3] and pin and r[3] != pin or r[2] and candidates and set(r[2]) != set(candidates):
            raise BundleError(f"{key}: the catalog and the pin sheet decide differently")
        by[key] = (*r[:2], r[2] or candidates, r[3] or pin, *r[4:])
    return list(by.values())


def term_rows(text: str, name: str, term: str, delimiter: str = ",") -> list[tuple[str, str]]:
    """(logical name, term id) of a CSV text with a header; blank rows are skipped, the last of a name wins."""
    rows = list(csv.DictReader(io.StringIO(text), delimiter=delimiter))
    if rows and not {name, term} <= set(rows[0]):
        raise BundleError(f"no columns {name!r} and {term!r} among {sorted(rows[0])}")
    kept = {" ".join(r[name].split()).casefold(): (r[name].strip(), r[term].strip()) for r in rows if (r[name] or "").strip() and (r[term] or "").strip()}
    return list(kept.values())


def _sections(spark: SparkSession, path: str) -> tuple[dict[str, Any], str | None]:
    """({section: document}, path of a glossary in CSV)."""
    files = _listing(spark, path)
    if files is None:
        document = public(_parsed(spark, path), path)
        out = {}
        for section, keys in KEYS.items():
            key = next((k for k in keys if k in document), None)
            if key:
                out[section] = document if key == "entries" else document[key]
        if "allow_lists" not in out and any(k in document for k in ALLOW_LISTS):
            out["allow_lists"] = {k: x for k, x in document.items() if k in ALLOW_LISTS}
        if not out:
            raise BundleError(f"{path} has none of the sections {sorted(KEYS)}")
        return out, None
    out, glossary = {}, None
    for section, (stems, endings) in FILES.items():
        found = [stem + e for stem in stems for e in endings if stem + e in files]
        if len(found) > 1:
            raise BundleError(f"{path}: {', '.join(sorted(found))} all claim the section {section}")
        if found and found[0].endswith(".csv"):
            glossary = files[found[0]]
        elif found:
            out[section] = _parsed(spark, files[found[0]])
    if not out and not glossary:
        raise BundleError(f"{path} holds no file of a bundle, only {', '.join(sorted(files)) or 'nothing'}")
    return out, glossary


def load_bundle(spark: SparkSession, path: str, overlays: Iterable[Mapping[str, Any]] = (), term_columns: tuple[str, str] = ("logical_name", "term_id"), encoding: str = "utf-8-sig") -> Vocabulary:
    """The Vocabulary of a folder or of one JSON object, with layers of overlays on top, the last one first."""
    sections, glossary = _sections(spark, path)
    rows = catalog_rows(sections["catalog"]) if "catalog" in sections else []
    if "pins" in sections:
        rows = with_pins(rows, sections["pins"])
    terms = term_rows(_text(spark, glossary, encoding), *term_columns) if glossary else list(strings(sections.get("terms", {}), "the glossary").items())
    over = [r for k, custom in enumerate(overlays) for r in overlay_rows(custom, k)]
    parts = [
        literal(spark, [(i, *r) for i, r in enumerate(rows)], CATALOG_SCHEMA),
        literal(spark, over, OVERLAY_SCHEMA),
        literal(spark, allow_rows(sections.get("allow_lists", {})), "list string, token string"),
        literal(spark, class_rows(sections.get("class_words", {})), "abbrev string, full string"),
        literal(spark, terms, "logical_name string, term_id string"),
    ]
    return Vocabulary(*(p.coalesce(1) for p in parts))
