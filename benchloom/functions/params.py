"""Generation parameters: typed coercion and layered overrides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom import fixed
from benchloom.functions import variants as V
from benchloom.functions.text import strip_ws

KNOWN = [*fixed.INT_PARAMETERS, *fixed.FLOAT_PARAMETERS, *fixed.BOOL_PARAMETERS, *fixed.STRING_PARAMETERS]


def _text(v: Column) -> Column:
    return strip_ws(F.try_variant_get(v, "$", "string"))


def _int(v: Column, kind: Column) -> Column:
    whole = F.when(_text(v).rlike(r"^[+-]?\d+$"), _text(v).try_cast("bigint"))
    # whole numbers stay whole: a double holds them exactly up to 2^53 only
    number = F.try_variant_get(v, "$", "double").try_cast("bigint")
    return F.when(kind == "STRING", whole).when(kind.isin("LONG", "BIGINT"), F.try_variant_get(v, "$", "bigint")).when(kind != "BOOLEAN", number)


def _float(v: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", _text(v).try_cast("double")).when(kind != "BOOLEAN", F.try_variant_get(v, "$", "double"))


def _bool(v: Column, kind: Column) -> Column:
    word = F.lower(_text(v))
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(
        kind == "STRING", F.when(word.isin(fixed.TRUE_WORDS), True).when(word.isin(fixed.FALSE_WORDS), False)
    )


def _resolution(v: Column, kind: Column) -> Column:
    text = F.btrim(F.regexp_replace(F.try_variant_get(v, "$", "string"), r"\s+", " "))
    return F.when((kind == "STRING") & text.rlike(r"^\d+\s*[xX*]\s*\d+$"), text)


def _reader(key: str):
    if key in fixed.INT_PARAMETERS:
        return _int, "integer"
    if key in fixed.FLOAT_PARAMETERS:
        return _float, "number"
    if key in fixed.BOOL_PARAMETERS:
        return _bool, "boolean"
    if key == "resolution":
        return _resolution, "resolution"
    return (lambda v, kind: V.as_text(v)), "string"


def coerce(params: Column, keys: list[str] | None = None) -> Column:
    """Struct of typed known keys, ``extra`` map of unknown ones, ``errors`` and ``warnings``.

    A key that is present but does not fit its type is an error; booleans never pass as
    numbers; unknown keys are kept as text and reported.
    """
    wanted = KNOWN if keys is None else keys

    def typed(key: str):
        reader, _ = _reader(key)
        return lambda v: V.let(V.kind(v), lambda k: reader(v, k))

    def read(entries: Column) -> Column:
        # One pass turns the object into a map; every key is then one lookup.
        fields = []
        for key in wanted:
            fields.append(V.let(F.try_element_at(entries, F.lit(key)), typed(key)).alias(key))
        return F.struct(*fields, F.map_keys(entries).alias("present"), F.map_filter(entries, lambda k, _: ~k.isin(KNOWN)).alias("unknown"))

    def report(r: Column) -> Column:
        errors = [
            F.when(r[k].isNull() & F.array_contains(r["present"], k), F.lit(f"{k}: expected {_reader(k)[1]}")) for k in wanted
        ]
        return F.struct(
            *[r[k].alias(k) for k in wanted],
            F.transform_values(r["unknown"], lambda _, v: V.as_text(v)).alias("extra"),
            F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors"),
            F.transform(F.map_keys(r["unknown"]), lambda k: F.concat(F.lit("unknown parameter: "), k)).alias("warnings"),
        )

    return V.let(V.let(F.try_variant_get(params, "$", "map<string,variant>"), read), report)


def overlay(base: Column, over: Column | None) -> Column:
    """Map of text values where ``over`` wins; no duplicate keys are ever built."""
    if over is None:
        return base
    over = F.coalesce(over, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.map_concat(kept, over)


def expand_resolution(layer: Column) -> Column:
    """``resolution`` of one layer as width and height, below explicit ones of the same layer."""
    size = F.split(F.lower(F.regexp_replace(F.try_element_at(layer, F.lit("resolution")), r"[*]", "x")), r"\s*x\s*")
    dims = F.when(
        F.size(size) == 2,
        F.map_from_arrays(
            F.array(F.lit("width"), F.lit("height")), F.transform(size, lambda s: s.try_cast("bigint").cast("string"))
        ),
    )
    rest = F.map_filter(layer, lambda k, _: k != "resolution")
    return F.when(dims.isNull(), rest).otherwise(overlay(dims, rest))


def merge_layers(*layers: Column) -> Column:
    """Right-most layer wins, each one with its resolution expanded first."""
    out = layers[0]
    for layer in layers[1:]:
        out = overlay(out, F.when(layer.isNotNull(), expand_resolution(layer)))
    return out


def negative_prompt(own: Column, run_wide: str | None) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), F.lit((run_wide or "").strip()))


def signature(params: Column) -> Column:
    """Order-free fingerprint of a parameter map."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(params))), 256)


