"""Structured model replies parsed with Column expressions.

A ``ReplySpec`` is read once, when the expression is built; the rows only see the
finished expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom import fixed
from benchloom.functions import variants as V
from benchloom.functions.text import WS, blank_to_null, col, java_pattern, strip_ws


@dataclass(frozen=True)
class ReplySpec:
    """What a reply should hold.

    ``aliases``: names under which a field may appear, first hit wins.
    ``fallbacks``: regexes with one group, tried when no name hits.
    ``required`` / ``required_in`` / ``preferred_in``: always, per mode, and per mode but
    only while both ``final_answer`` and ``final_choice`` are empty.
    """

    fields: tuple[str, ...] = ()
    aliases: dict[str, list[str]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    required_in: dict[str, list[str]] = field(default_factory=dict)
    preferred_in: dict[str, list[str]] = field(default_factory=dict)
    fallbacks: dict[str, list[str]] = field(default_factory=dict)
    choices: dict[str, list[str]] = field(default_factory=dict)
    trace_keys: tuple[str, ...] = ("thinking_content",)
    trace_tags: tuple[str, ...] = ("thinking",)
    trace_patterns: tuple[str, ...] = ()
    format: str = "tag_blocks"  # or json_object, markdown_sections; anything else is plain text

    def __post_init__(self) -> None:
        for patterns in [*self.fallbacks.values(), self.trace_patterns]:
            for pattern in patterns:
                if re.compile(pattern).groups < 1:
                    raise ValueError(f"pattern needs a group: {pattern}")

    def known_fields(self) -> list[str]:
        return list(dict.fromkeys([*self.fields, *self.aliases, *self.required]))

    def names(self, name: str) -> list[str]:
        return self.aliases.get(name) or [name]


def _literal(text: str) -> str:
    """``text`` as a Java regex literal."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def _first(values: list[Column]) -> Column:
    return F.coalesce(*values) if values else F.lit(None).cast("string")


# --- T1 -------------------------------------------------------------------------------
def json_payload(reply: Column | str) -> Column:
    """First candidate that is a JSON object: outermost braces, fenced block, whole text."""

    def candidates(text: Column) -> Column:
        span = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
        fence = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
        return F.coalesce(*[V.let(c, V.parse_object) for c in (span, fence, text)])

    return V.let(strip_ws(reply), candidates)


def json_field(payload: Column | str, name: str, aliases: list[str] = ()) -> Column:
    """Text of a field, filled from its aliases while empty."""
    return _first([F.nullif(V.get_text(payload, key), F.lit("")) for key in [name, *aliases]])


def json_text_value(reply: Column | str, keys: list[str]) -> Column:
    """First non-empty of ``keys`` in an embedded object, else the whole stripped reply."""
    hits = lambda p: F.coalesce(*[strip_ws(F.nullif(V.get_text(p, k), F.lit(""))) for k in keys])
    return F.coalesce(V.let(json_payload(reply), hits), strip_ws(reply))


def json_reply(reply: Column | str, spec: ReplySpec) -> Column:
    """Struct(status, fields map, missing array) of a JSON reply."""
    names = spec.known_fields()

    def read(payload: Column) -> Column:
        values = [json_field(payload, n, spec.aliases.get(n, [])).alias(n) for n in names]
        return F.struct(payload.isNotNull().alias("found"), *values)

    def judge(r: Column) -> Column:
        absent = [F.when(r[n].isNull() | (r[n] == "[]"), F.lit(n)) for n in spec.required]
        missing = F.filter(F.array(*absent).cast("array<string>"), lambda x: x.isNotNull())
        return F.struct(
            F.when(~r["found"], "invalid").when(F.size(missing) == 0, "parsed").otherwise("partial").alias("status"),
            _field_map({n: r[n] for n in names}).alias("fields"),
            missing.alias("missing"),
        )

    return V.let(V.let(json_payload(reply), read), judge)


def _is_not(name: str):
    return lambda k, _: k != name


def _empty_map() -> Column:
    return F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))


def json_structured(reply: Column | str, spec: ReplySpec, artifact_metadata: Column | None = None) -> Column:
    """The struct of ``structured_reply`` with every field of the object, whether the spec names it or not.

    A field that is empty is filled from its aliases; the reasoning trace becomes ``thinking``
    unless the object has that key.
    """

    def read(text: Column) -> Column:
        return F.struct(json_payload(text).alias("payload"), reasoning_trace(text, spec, artifact_metadata).alias("trace"))

    def judge(r: Column) -> Column:
        all_fields = F.coalesce(F.transform_values(F.try_variant_get(r["payload"], "$", "map<string,variant>"), lambda _, v: V.as_text(v)), _empty_map())
        fields = all_fields
        value = lambda n: F.nullif(F.try_element_at(all_fields, F.lit(n)), F.lit(""))
        for name, aliases in spec.aliases.items():
            filled = _first([value(n) for n in aliases])
            others = F.map_filter(fields, _is_not(name))
            fields = F.when(value(name).isNull() & filled.isNotNull(), F.map_concat(others, F.create_map(F.lit(name), filled))).otherwise(fields)
        trace = r["trace"]["text"]
        with_trace = F.map_concat(fields, F.create_map(F.lit("thinking"), trace))
        fields = F.when(trace.isNotNull() & ~F.map_contains_key(fields, "thinking"), with_trace).otherwise(fields)

        def done(fields: Column) -> Column:
            got = lambda n: F.try_element_at(fields, F.lit(n))
            absent = [F.when(F.coalesce(got(n), F.lit("")).isin("", "[]"), F.lit(n)) for n in spec.required]
            missing = F.filter(F.array(*absent).cast("array<string>"), lambda x: x.isNotNull())
            found = r["payload"].isNotNull()
            none = F.lit(None).cast("string")
            kept = F.when(found, fields).otherwise(_empty_map())
            return F.struct(
                F.when(~found, "invalid").when(F.size(missing) == 0, "parsed").otherwise("partial").alias("status"),
                kept.alias("fields"), F.when(found, missing).otherwise(F.array(*[F.lit(n) for n in spec.required]).cast("array<string>")).alias("missing"),
                _empty_map().alias("fallback_source"), F.when(found, trace).otherwise(none).alias("trace_text"),
                F.when(found, r["trace"]["source"]).otherwise("none").alias("trace_source"), kept.alias("raw_hits"),
            )

        return V.let(fields, done)

    return V.let(V.let(strip_ws(reply), read), judge)


def plain_structured(reply: Column | str, spec: ReplySpec, artifact_metadata: Column | None = None) -> Column:
    """The struct of ``structured_reply`` with the whole reply as ``text``; only an empty reply is invalid."""

    def read(text: Column) -> Column:
        return F.struct(text.alias("text"), reasoning_trace(text, spec, artifact_metadata).alias("trace"))

    def judge(r: Column) -> Column:
        values = {"text": F.coalesce(r["text"], F.lit("")), "thinking": r["trace"]["text"]}
        absent = [F.when(F.coalesce(values.get(n, F.lit(None).cast("string")), F.lit("")).isin("", "[]"), F.lit(n)) for n in spec.required]
        return F.struct(
            F.when(values["text"] == "", "invalid").otherwise("parsed").alias("status"), _field_map(values).alias("fields"),
            F.filter(F.array(*absent).cast("array<string>"), lambda x: x.isNotNull()).alias("missing"), _empty_map().alias("fallback_source"),
            r["trace"]["text"].alias("trace_text"), r["trace"]["source"].alias("trace_source"), _empty_map().alias("raw_hits"),
        )

    return V.let(V.let(strip_ws(reply), read), judge)


def structured_reply(reply: Column | str, spec: ReplySpec, mode: str = "", artifact_metadata: Column | None = None) -> Column:
    """Struct(status, fields, missing, fallback_source, trace_text, trace_source, raw_hits) by the format of the spec."""
    if spec.format in ("json", "json_object"):
        return json_structured(reply, spec, artifact_metadata)
    if spec.format == "tag_blocks":
        return tag_reply(reply, spec, mode, artifact_metadata)
    if spec.format == "markdown_sections":
        return section_reply(reply, spec, mode, artifact_metadata)
    return plain_structured(reply, spec, artifact_metadata)


def _field_map(values: dict[str, Column]) -> Column:
    """Map of the fields that have a value."""
    if not values:
        return F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    pairs = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("k"), v.alias("v"))) for n, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))


# --- T2 -------------------------------------------------------------------------------
def tag_value(reply: Column | str, names: list[str]) -> Column:
    """Content of the first ``<name>…</name>`` that is not blank, names in order."""
    return _first(
        [
            blank_to_null(F.regexp_extract(col(reply), f"(?isu)<{_literal(n)}>(.*?)</{_literal(n)}>", 1))
            for n in names
        ]
    )


def pattern_value(reply: Column | str, patterns: list[str]) -> Column:
    """Group 1 of the first pattern with a non-blank hit, cut at the fixed length."""
    return _first(
        [
            F.substring(blank_to_null(F.regexp_extract(col(reply), f"(?ismU){java_pattern(p)}", 1)), 1, fixed.PATTERN_VALUE_CHARS)
            for p in patterns
        ]
    )


# --- T3 -------------------------------------------------------------------------------
def section_value(reply: Column | str, names: list[str]) -> Column:
    """Text under a ``# name`` heading, else after a ``name:`` label, names in order."""
    hits = []
    for n in names:
        name = _literal(n)
        heading = rf"(?isu)(?:^|\n)#+\s*{name}\s*\n(.*?)(?=\n#+\s|\z)"
        label = rf"(?isu)(?:^|\n){name}\s*:\s*(.*?)(?=\n[A-Z][A-Za-z0-9 _-]*\s*:|\z)"
        hits += [blank_to_null(F.regexp_extract(col(reply), p, 1)) for p in (heading, label)]
    return _first(hits)


# --- T5 -------------------------------------------------------------------------------
def reasoning_trace(reply: Column | str, spec: ReplySpec, artifact_metadata: Column | None = None) -> Column:
    """Struct(text, source): artifact metadata, then a tag, then a pattern."""
    meta = F.lit(None).cast("string")
    if artifact_metadata is not None:
        meta = _first([blank_to_null(V.get_text(artifact_metadata, k)) for k in spec.trace_keys])
    tag = _first([tag_value(reply, spec.names(t)) for t in spec.trace_tags])
    pattern = pattern_value(reply, list(spec.trace_patterns))
    found = lambda c, source: F.when(c.isNotNull(), F.struct(c.alias("text"), F.lit(source).alias("source")))
    nothing = F.struct(F.lit(None).cast("string").alias("text"), F.lit("none").alias("source"))
    # Lazy: a pattern is only tried when neither metadata nor a tag has the trace.
    return F.coalesce(
        V.let(meta, lambda c: found(c, "artifact_metadata")),
        V.let(tag, lambda c: found(c, "tag")),
        V.let(pattern, lambda c: found(c, "text_pattern")),
        nothing,
    )


def reasoning_tail(reply: Column | str) -> Column:
    """Text that follows reasoning/analysis/because, cut at the fixed length."""
    tail = F.regexp_extract(col(reply), rf"(?isu)(?:reasoning|analysis|because)[:{WS}]+(.+)", 1)
    return blank_to_null(F.substring(tail, 1, fixed.REASONING_TAIL_CHARS))


# --- T6 -------------------------------------------------------------------------------
def normalize_choice(value: Column | str, choices: dict[str, list[str]] | None = None) -> Column:
    """Alias table to the canonical choice, bare a/b upper-cased, other text stripped."""
    text = blank_to_null(value)
    known: dict[str, str] = {}
    for canonical, names in (choices or {}).items():
        for name in names:
            if name.strip():
                known.setdefault(name.strip().lower(), canonical)
    plain = F.when(F.upper(text).isin("A", "B"), F.upper(text)).otherwise(text)
    if not known:
        return plain
    table = F.create_map(*[F.lit(part) for pair in known.items() for part in pair])
    return F.coalesce(F.try_element_at(table, F.lower(text)), plain)


# --- T7 -------------------------------------------------------------------------------
def missing_required(values: dict[str, Column], spec: ReplySpec, mode: str = "") -> Column:
    """Array of required fields (always, in ``mode``, preferred in ``mode``) without a value."""
    nothing = F.lit(None).cast("string")
    value = lambda n: values.get(n, nothing)
    names = list(spec.required)
    if mode:
        names += [n for n, modes in spec.required_in.items() if mode in modes and n not in names]
    checks = [F.when(value(n).isNull(), F.lit(n)) for n in names]
    if mode and mode in spec.preferred_in.get("final_answer", []) and "final_answer" not in names:
        both = value("final_answer").isNull() & value("final_choice").isNull()
        checks.append(F.when(both, F.lit("final_answer")))
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def _block_reply(reply: Column | str, spec: ReplySpec, mode: str, extract, artifact_metadata: Column | None, choices: bool) -> Column:
    names = spec.known_fields()

    def read(text: Column) -> Column:
        hits = [extract(text, spec.names(n)).alias(f"h{i}") for i, n in enumerate(names)]
        spares = [pattern_value(text, spec.fallbacks.get(n, [])).alias(f"p{i}") for i, n in enumerate(names)]
        return F.struct(*hits, *spares, reasoning_trace(text, spec, artifact_metadata).alias("trace"))

    def merge(r: Column) -> Column:
        values = {n: F.coalesce(r[f"h{i}"], r[f"p{i}"]) for i, n in enumerate(names)}
        source = {n: F.when(r[f"h{i}"].isNull() & r[f"p{i}"].isNotNull(), F.lit("pattern")) for i, n in enumerate(names)}
        if choices and "final_choice" in values:
            values["final_choice"] = V.let(values["final_choice"], lambda v: normalize_choice(v, spec.choices))
        trace = r["trace"]["text"]
        values["thinking"] = F.coalesce(values["thinking"], trace) if "thinking" in values else trace
        missing = missing_required(values, spec, mode)
        return F.struct(
            F.when(F.size(missing) == 0, "parsed").otherwise("partial").alias("status"),
            _field_map(values).alias("fields"),
            missing.alias("missing"),
            _field_map(source).alias("fallback_source"),
            trace.alias("trace_text"),
            r["trace"]["source"].alias("trace_source"),
            _field_map({n: r[f"h{i}"] for i, n in enumerate(names)}).alias("raw_hits"),
        )

    return V.let(V.let(strip_ws(reply), read), merge)


def tag_reply(reply: Column | str, spec: ReplySpec, mode: str = "", artifact_metadata: Column | None = None) -> Column:
    """Struct(status, fields, missing, fallback_source, trace_text, trace_source, raw_hits) of a tagged reply."""
    return _block_reply(reply, spec, mode, tag_value, artifact_metadata, choices=True)


def section_reply(reply: Column | str, spec: ReplySpec, mode: str = "", artifact_metadata: Column | None = None) -> Column:
    """Same struct for a reply in markdown sections or labels."""
    return _block_reply(reply, spec, mode, section_value, artifact_metadata, choices=False)


# --- T4 -------------------------------------------------------------------------------
def plain_reply(reply: Column | str) -> Column:
    """Struct(status, text): the stripped reply, invalid when empty."""
    text = blank_to_null(reply)
    return F.struct(F.when(text.isNull(), "invalid").otherwise("parsed").alias("status"), text.alias("text"))
