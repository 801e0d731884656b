"""Versioned JSON of a document's tables, as text per document, and the schemas of these."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse import parse

VERSION = 1
_PARTS = {"diagnostics": "diagnostics", "nodes": "nodes", "pairs": "pair_links", "container_pairs": "container_pairs"}
_SPAN = {"type": "object", "properties": {"start": {"type": "integer", "minimum": 0}, "end": {"type": "integer", "minimum": 0}}, "required": ["start", "end"], "additionalProperties": False}


def _item(name: str, r: dict) -> dict:
    span = lambda a, b: {"start": r[a], "end": r[b]}
    if name == "pairs":
        return {"kind": r["kind"], "open": span("open_start", "open_end"), "close": span("close_start", "close_end")}
    if name == "container_pairs":
        return {"kind": r["kind"], "open": {"offset": r["open_norm"]}, "close": {"offset": r["close_norm"]}}
    if name == "nodes":
        return {"kind": r["kind"], "span": span("start", "end")}
    more = {"codepoint": r["codepoint"]} if r["codepoint"] is not None else {}
    return {"kind": r["kind"], "severity": r["severity"], "source": r["source"], "span": span("start", "end")} | more


def envelope(name: str, rows: list[dict]) -> str:
    return json.dumps({"schema_version": VERSION, "data": [_item(name, r) for r in rows]}, ensure_ascii=False, separators=(",", ":"))


def wire_column(name: str, rows: Column) -> Column:
    """The envelope of an array column of such rows; nulls inside items are left out."""
    span = lambda x, a="start", b="end": F.struct(x[a].alias("start"), x[b].alias("end"))
    make = {
        "diagnostics": lambda x: F.struct(x["kind"], x["severity"], x["source"], span(x).alias("span"), x["codepoint"]),
        "nodes": lambda x: F.struct(x["kind"], span(x).alias("span")),
        "pairs": lambda x: F.struct(x["kind"], span(x, "open_start", "open_end").alias("open"), span(x, "close_start", "close_end").alias("close")),
        "container_pairs": lambda x: F.struct(x["kind"], F.struct(x["open_norm"].alias("offset")).alias("open"), F.struct(x["close_norm"].alias("offset")).alias("close")),
    }[name]
    return F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.transform(rows, make).alias("data")))


def wire(df: DataFrame, names=tuple(_PARTS), key: str = "doc_id", source: str = "source") -> DataFrame:
    """``key`` and one JSON column for each name."""
    found = parse(df.select(key, source), [_PARTS[n] for n in names], source)
    return found.select(key, *[wire_column(n, F.col(f"parsed.{_PARTS[n]}")).alias(f"{n}_json") for n in names])


def json_schema(name: str) -> dict:
    kind = {"type": "string"}
    properties = {
        "diagnostics": {"kind": kind, "severity": {"enum": ["error", "warning", "note"]}, "source": {"enum": ["source", "internal"]}, "span": _SPAN, "codepoint": {"type": "string", "minLength": 1, "maxLength": 1}},
        "nodes": {"kind": kind, "span": _SPAN},
        "pairs": {"kind": kind, "open": _SPAN, "close": _SPAN},
        "container_pairs": {"kind": kind, **{k: {"type": "object", "properties": {"offset": {"type": "integer", "minimum": 0}}, "required": ["offset"], "additionalProperties": False} for k in ("open", "close")}},
    }[name]
    item = {"type": "object", "properties": properties, "required": [k for k in properties if k != "codepoint"], "additionalProperties": False}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name, "type": "object", "properties": {"schema_version": {"const": VERSION}, "data": {"type": "array", "items": item}}, "required": ["schema_version", "data"], "additionalProperties": False}
