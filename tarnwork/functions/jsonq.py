"""JSON columns: containment compiled to column expressions, canonical form, lenient decoding."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.runtime import ship_active


def contains(document: Column, wanted: dict[str, Any]) -> Column:
    """Whether a JSON text contains the object `wanted`, anchored at its root.

    Every key must be there; a wanted list must be a subset of the list found, an object is contained in turn,
    scalars are equal in type and value (numbers by value). An empty object is contained in every object.
    """
    if not isinstance(wanted, dict):
        raise ValueError("a containment filter must be a JSON object")
    variant = F.try_parse_json(document)
    out = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    for path, value in _leaves("$", wanted):
        out = out & _holds(variant, path, value)
    return F.coalesce(out, F.lit(False))


def _leaves(path: str, value: dict[str, Any]):
    for key, item in value.items():
        quoted = json.dumps(key, ensure_ascii=False).replace("'", "\\'")
        at = f"{path}[{quoted}]" if not key.isidentifier() else f"{path}.{key}"
        if isinstance(item, dict) and item:
            yield from _leaves(at, item)
        else:
            yield at, item


def _typed(path: str, variant: Column, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def _holds(variant: Column, path: str, value: Any) -> Column:
    shape = F.schema_of_variant(_typed(path, variant, "variant"))
    if isinstance(value, dict):
        return shape.startswith("OBJECT")
    if isinstance(value, list):
        items = _typed(path, variant, "array<variant>")
        out = shape.startswith("ARRAY")
        for item in value:
            out = out & F.exists(items, _test(item))
        return out
    return _equals(_typed(path, variant, "variant"), value)


def _test(item: Any):
    return lambda found: _equals(found, item)


def _equals(found: Column, value: Any) -> Column:
    shape = F.schema_of_variant(found)
    if value is None:
        return shape == "VOID"
    if isinstance(value, bool):
        return (shape == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)") & (F.try_variant_get(found, "$", "double") == F.lit(float(value)))
    return (shape == "STRING") & (F.try_variant_get(found, "$", "string") == F.lit(str(value)))


def canonical_text(value: Any) -> str:
    """JSON with sorted keys and fixed separators."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _canonical_or_none(text: str | None) -> str | None:
    try:
        return None if text is None else canonical_text(json.loads(text))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(_canonical_or_none)


def canonical(text: Column) -> Column:
    """Canonical form of JSON texts; null for null and invalid ones."""
    ship_active()
    return _canonical(text)


def string_list(text: Column) -> Column:
    """A JSON list in a text column as array of strings; empty for null, malformed and other JSON."""
    return F.coalesce(F.from_json(F.when(text.rlike(r"^\s*\["), text), "array<string>"), F.array().cast("array<string>"))
