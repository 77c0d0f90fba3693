"""The interchange form of results: a JSON schema made from a DataFrame's own, checks of rows against it, text tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {T.StringType: "string", T.BooleanType: "boolean", T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "number", T.FloatType: "number"}


def json_schema(kind: T.DataType, title: str | None = None, nullable: bool = False) -> dict[str, Any]:
    """JSON Schema (2020-12) of a Spark type.  Fields that cannot be null are required, others may also be null."""
    if isinstance(kind, T.StructType):
        out: dict[str, Any] = {"type": "object", "properties": {f.name: json_schema(f.dataType, nullable=f.nullable) for f in kind}, "required": [f.name for f in kind if not f.nullable]}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType, nullable=kind.containsNull)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType, nullable=kind.valueContainsNull)}
    elif type(kind) in _PLAIN:
        out = {"type": _PLAIN[type(kind)]}
    else:
        raise ValueError(f"no JSON form for {kind.simpleString()}")
    if nullable and isinstance(out["type"], str):
        out["type"] = [out["type"], "null"]
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title, **out} if title else out


def export_schema(rows: DataFrame, path: str, title: str = "result") -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json_schema(rows.schema, title), f, indent=2, ensure_ascii=False)


def load_schema(path: str) -> dict[str, Any]:
    """A schema from a file.  References elsewhere are refused: nothing is ever fetched."""
    with open(path, encoding="utf-8") as f:
        schema = json.load(f)

    def walk(node):
        if isinstance(node, dict):
            ref = node.get("$ref")
            if isinstance(ref, str) and not ref.startswith("#"):
                raise ValueError(f"remote reference {ref!r}")
            for x in node.values():
                walk(x)
        elif isinstance(node, list):
            for x in node:
                walk(x)

    walk(schema)
    return schema


def problems(value: Any, schema: dict[str, Any], at: str = "$") -> list[str]:
    """What is wrong with a value: types, required fields and items, by place.  Unknown fields are allowed."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    is_ = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None}
    is_["integer"] = isinstance(value, int) and not isinstance(value, bool)
    is_["number"] = is_["integer"] or isinstance(value, float)
    if kinds and not any(is_.get(k, False) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if isinstance(value, dict):
        out += [f"{at}: no {k}" for k in schema.get("required", []) if k not in value]
        rest = schema.get("additionalProperties")
        for k, x in value.items():
            inner = schema.get("properties", {}).get(k, rest if isinstance(rest, dict) else None)
            out += problems(x, inner, f"{at}.{k}") if inner else []
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def invalid_rows(lines: DataFrame, schema: dict[str, Any], column: str = "value") -> DataFrame:
    """The rows whose JSON text does not fit a schema, with `problem`, the first one."""

    @F.pandas_udf("string")
    def check(texts):
        def first(text):
            try:
                found = problems(json.loads(text), schema)
            except (TypeError, ValueError) as e:
                return f"$: {e}"
            return found[0] if found else None

        return texts.map(first)

    return lines.withColumn("problem", check(F.col(column))).where("problem is not null")


def table(rows: list[dict[str, Any]], columns: list[str]) -> str:
    """A text table; numbers stand to the right."""
    cells = [columns, *[["" if r[c] is None else str(r[c]) for c in columns] for r in rows]]
    width = [max(len(x[k]) for x in cells) for k in range(len(columns))]
    right = [bool(rows) and all(isinstance(r[c], (int, float)) or r[c] is None for r in rows) for c in columns]
    return "\n".join("  ".join(x[k].rjust(width[k]) if right[k] else x[k].ljust(width[k]) for k in range(len(columns))).rstrip() for x in cells)


def render_audit(audit, limit: int = 20) -> str:
    """An Audit as text: totals, findings by reason, and the most frequent unknown tokens with what is proposed."""
    total = audit.summary().first().asDict()
    lines = [f"{k.replace('_', ' ')}: {v}" for k, v in total.items()]
    findings = [r.asDict() for r in audit.findings().orderBy(F.desc("occurrences"), "code").collect()]  # ten codes
    unknown = [r.asDict() for r in audit.suggestions(limit).collect()]
    return "\n\n".join(["\n".join(lines), table(findings, ["code", "occurrences"]), table(unknown, ["token", "occurrences", "proposal"])])
