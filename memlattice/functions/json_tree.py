"""JSON documents as columns: constructors, tests, sizes, access and iteration on variants, and where a text is malformed."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null() -> Column:
    return F.parse_json(F.lit("null"))


def _value(x: Column) -> Column:
    return F.try_variant_get(F.to_variant_object(F.struct(x.alias("x"))), "$.x", "variant")


def boolean(x: Column) -> Column:
    return _value(x.cast("boolean"))


def from_number(x: Column) -> Column:
    return _value(x)


def from_string(x: Column) -> Column:
    return _value(x.cast("string"))


def _text(v: Column) -> Column:
    """A value as JSON; what isn't there is null."""
    return F.coalesce(F.to_json(v), F.lit("null"))


def array(*values: Column) -> Column:
    """An array of values."""
    return F.parse_json(F.concat(F.lit("["), F.concat_ws(",", *map(_text, values)), F.lit("]")))


def object_(**members: Column) -> Column:
    """An object of named values."""
    return F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(json.dumps(k) + ":"), _text(v)) for k, v in members.items())), F.lit("}")))


@F.arrow_udf(T.StringType())
def problem(text: pa.Array) -> pa.Array:
    """Where and why a text isn't JSON, as line:column: message; null where it is, and for null. What follows the first value
    is not looked at."""

    def of(x: str | None) -> str | None:
        try:
            if x is not None:
                json.JSONDecoder().raw_decode(x, len(x) - len(x.lstrip(" \t\r\n")))
            return None
        except json.JSONDecodeError as e:
            return f"{e.lineno}:{e.colno}: {e.msg}"

    return pa.array([of(x) for x in text.to_pylist()], pa.string())


def parsed(text: Column) -> Column:
    """A variant; null where the text isn't JSON."""
    return F.try_parse_json(text)


def kind(v: Column) -> Column:
    """null, true, false, number, string, array or object; null for no document."""
    s = F.upper(F.schema_of_variant(v))
    return (
        F.when(v.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(v), "null").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s == "STRING", "string")
        .when(s == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "true").otherwise("false")).otherwise("number")
    )


def array_size(v: Column) -> Column:
    """Elements of an array, else null."""
    return F.when(kind(v) == "array", F.size(F.try_variant_get(v, "$", "array<variant>"))).cast("long")


def object_size(v: Column) -> Column:
    """Members of an object, else null."""
    return F.when(kind(v) == "object", F.size(F.try_variant_get(v, "$", "map<string,variant>"))).cast("long")


def keys(v: Column) -> Column:
    """Keys of an object in order, else null."""
    return F.when(kind(v) == "object", F.sort_array(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))))


def member(v: Column, key: str) -> Column:
    """The value at a key, or null."""
    return F.try_variant_get(v, f"$['{key}']", "variant")


def element(v: Column, index: int) -> Column:
    """The element at an index; past the end null."""
    return F.try_variant_get(v, f"$[{index}]", "variant")


def number(v: Column) -> Column:
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def whole(v: Column) -> Column:
    """A number without its fraction."""
    n = number(v)
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("long")


def string(v: Column) -> Column:
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def elements(v: Column, backwards: bool = False) -> Column:
    """The elements of an array in order, or from the last to the first, for posexplode or transform; else null."""
    xs = F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))
    return F.reverse(xs) if backwards else xs


def members(v: Column, backwards: bool = False) -> Column:
    """The (key, value) pairs of an object by key, or backwards, for posexplode or transform; else null."""
    pairs = F.when(kind(v) == "object", F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))
    by_key = F.array_sort(pairs, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.reverse(by_key) if backwards else by_key
