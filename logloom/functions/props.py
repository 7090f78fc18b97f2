"""Access to the JSON ``properties`` column by dotted path.

Filters parse only the first key of the path out of the text. A missing or differently typed value counts
as 0 (numbers) or empty text, never as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.base import let, nonempty
from logloom.functions.json_text import as_number, as_text


def _step(key: str) -> str:
    escaped = key.replace("\\", "\\\\").replace("'", "\\'")
    return f"['{escaped}']"


def _path(keys: list[str]) -> str:
    return "$" + "".join(_step(k) for k in keys)


def first_member(properties: Column, key: str) -> Column:
    schema = T.StructType([T.StructField(key, T.VariantType())])
    return F.from_json(properties, schema).getField(key)


def _reach(value: Column, keys: list[str]) -> Column:
    return F.try_variant_get(value, _path(keys), "variant") if keys else value


def prop_number(properties: Column, path: str) -> Column:
    keys = path.split(".")
    head = first_member(properties, keys[0])
    if len(keys) == 1:
        return F.coalesce(as_number(head), F.lit(0.0).cast("double"))
    rest = keys[1:]
    return let(head, lambda v: F.coalesce(
        F.nullif(as_number(_reach(v, rest)), F.lit(0.0).cast("double")),
        as_number(_reach(F.try_parse_json(as_text(v)), rest)),
        F.lit(0.0).cast("double")))


def prop_text(properties: Column, path: str) -> Column:
    keys = path.split(".")
    head = first_member(properties, keys[0])
    if len(keys) == 1:
        return F.coalesce(as_text(head), F.lit(""))
    rest = keys[1:]
    return let(head, lambda v: F.coalesce(
        nonempty(as_text(_reach(v, rest))),
        as_text(_reach(F.try_parse_json(as_text(v)), rest)),
        F.lit("")))


def prop_exists(properties: Column, path: str) -> Column:
    keys = path.split(".")
    return _reach(first_member(properties, keys[0]), keys[1:]).isNotNull()


def _inner_object(value: Column) -> Column:
    """A text member that looks like a JSON object is opened, anything else stays as it is."""
    def body(v: Column) -> Column:
        text = F.trim(as_text(v))
        looks = text.startswith("{") & text.endswith("}")
        return F.when(looks, F.try_parse_json(text)).otherwise(v)
    return let(value, body)


def prop_nested(properties: Column, path: str) -> Column:
    """The variant at a dotted path, opening JSON-in-text at every level."""
    keys = path.split(".")
    node = first_member(properties, keys[0])
    for key in keys[1:]:
        node = F.try_variant_get(_inner_object(node), _path([key]), "variant")
    return node


def column_text(value: Column) -> Column:
    """Text of a scalar member; NULL for null, objects and arrays."""
    def body(v: Column) -> Column:
        shape = F.schema_of_variant(v)
        scalar = ~(shape.startswith("OBJECT") | shape.startswith("ARRAY") | (shape == "VOID"))
        return F.when(scalar, F.try_variant_get(v, "$", "string"))
    return let(value, body)
