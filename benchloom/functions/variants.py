"""Reading dynamic JSON objects held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom.functions.text import col


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A Column that is used several times is otherwise repeated in the generated code; nested
    parsers would grow past the limit of one Java method.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def path(key: str) -> str:
    """Variant path of one top-level key."""
    return f"$['{key}']"


def parse_object(text: Column) -> Column:
    """VARIANT of ``text`` when all of it is one JSON object, else null.

    ``try_parse_json`` ignores what follows the first value, so the text is parsed as the
    only element of an array: trailing text breaks the array, a second value is seen.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = lambda b: F.try_variant_get(b, "$[1]", "variant").isNull()
    opened = F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{"))
    return F.when(opened, let(boxed, lambda b: F.when(alone(b), F.try_variant_get(b, "$[0]", "variant"))))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def get(obj: Column | str, key: str) -> Column:
    return F.try_variant_get(col(obj), path(key), "variant")


def _text(v: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind(v) == "BOOLEAN", F.initcap(text)).otherwise(text)


def as_text(v: Column) -> Column:
    """Scalar as text, booleans as ``True``/``False``, nested values as JSON, JSON null as null."""
    return let(v, _text)


def get_text(obj: Column | str, key: str) -> Column:
    return let(get(obj, key), _text)


def get_number(obj: Column | str, key: str) -> Column:
    """Numeric value of a key; booleans and numeric-looking text are not numbers."""
    numeric = lambda v: kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return let(get(obj, key), lambda v: F.when(numeric(v), F.try_variant_get(v, "$", "double")))


def has_key(obj: Column | str, key: str) -> Column:
    return get(obj, key).isNotNull()


def text_list(v: Column) -> Column:
    """Array of texts for a JSON list, null for anything else."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(kind(v).startswith("ARRAY"), F.transform(items, as_text))


def numeric_map(v: Column) -> Column:
    """Map of the numeric entries of an object; booleans and text are left out."""
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    numeric = F.filter(
        entries, lambda e: kind(e["value"]).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    )
    return F.map_from_entries(
        F.transform(numeric, lambda e: F.struct(e["key"], F.try_variant_get(e["value"], "$", "double")))
    )
