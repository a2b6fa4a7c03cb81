"""Strict JSON accessors over VARIANT: a field of another type is unknown, not converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _kind(doc, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(col(doc), path, "variant"))


def jstr(doc, path: str) -> Column:
    """A JSON string, else null."""
    return F.when(_kind(doc, path) == "STRING", F.try_variant_get(col(doc), path, "string"))


def ju64(doc, path: str) -> Column:
    """A non-negative JSON integer, else null."""
    value = F.try_variant_get(col(doc), path, "bigint")
    return F.when((_kind(doc, path) == "BIGINT") & (value >= 0), value)


def jf64(doc, path: str) -> Column:
    """Any JSON number, else null."""
    kind = _kind(doc, path)
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(col(doc), path, "double"))


def jbool(doc, path: str) -> Column:
    """A JSON boolean, else null."""
    return F.when(_kind(doc, path) == "BOOLEAN", F.try_variant_get(col(doc), path, "boolean"))


def jlen(doc, path: str, kind: str = "ARRAY") -> Column:
    """Number of elements of a JSON array, or with ``kind`` OBJECT of keys of an object, else null."""
    text = F.when(_kind(doc, path).startswith(kind), F.to_json(F.try_variant_get(col(doc), path, "variant")))
    return (F.json_array_length(text) if kind == "ARRAY" else F.size(F.json_object_keys(text))).cast("long")


def jlist(doc, path: str, ddl: str) -> Column:
    """A JSON array as an array of ``ddl``, else null; elements' missing fields are null."""
    text = F.when(_kind(doc, path).startswith("ARRAY"), F.to_json(F.try_variant_get(col(doc), path, "variant")))
    return F.from_json(text, f"array<{ddl}>")


def jmap(doc, path: str) -> Column:
    """A JSON object as a map of VARIANT values, else null."""
    return F.when(_kind(doc, path).startswith("OBJECT"), F.try_variant_get(col(doc), path, "map<string, variant>"))


def jparts(doc, path: str) -> Column:
    """A JSON array as an array of VARIANT elements, else null; unlike :func:`jlist` it tells explicit nulls and types."""
    return F.when(_kind(doc, path).startswith("ARRAY"), F.try_variant_get(col(doc), path, "array<variant>"))


def present(doc, path: str) -> Column:
    """Whether a key is there, an explicit null counting."""
    return F.try_variant_get(col(doc), path, "variant").isNotNull()


def nonempty(value: Column) -> Column:
    """A text, '' counting as none."""
    return F.nullif(value, F.lit(""))
