"""Checks on generated scene texts, as arrays of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom import fixed
from benchloom.functions import variants as V
from benchloom.functions.text import col, contains_any, strip_ws, words

MSG = fixed.GUARD_MESSAGES


def _messages(*checks: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*checks), lambda m: m.isNotNull()))


def _second_person(low: Column) -> Column:
    return contains_any(low, fixed.SECOND_PERSON_MARKERS) | low.startswith("you")


def second_person(text: Column | str) -> Column:
    return V.let(F.lower(col(text)), _second_person)


def _forbidden(body: Column, low: Column, terms: list[str]) -> list[Column]:
    out = []
    for term in [t.strip() for t in terms if t.strip()]:
        bounded = fixed.WORD_BOUNDED_TERMS.get(term.lower())
        # The plain test spares most texts the pattern.
        hit = low.contains(term.lower().split()[0]) & body.rlike("(?iU)" + bounded) if bounded else low.contains(term.lower())
        out.append(F.when(hit, F.lit(MSG["forbidden"].format(term=term))))
    return out


def forbidden_terms(text: Column | str, terms: list[str]) -> list[Column]:
    """One nullable message per term; six known terms match on word bounds, others as substrings."""
    return _forbidden(col(text), F.lower(col(text)), terms)


def option_issues(options: Column) -> Column:
    """Messages about the two structured options."""
    n = F.coalesce(F.size(options), F.lit(0))
    ids = F.transform(options, lambda o: F.upper(strip_ws(F.coalesce(o["id"], F.lit("")))))
    per_option = F.transform(
        options,
        lambda o: F.when(strip_ws(F.coalesce(o["text"], F.lit(""))) == "", F.lit(MSG["option_text"])).when(
            contains_any(F.lower(o["text"]), fixed.THIRD_PATH_MARKERS), F.lit(MSG["third_path"])
        ),
    )
    return (
        F.when(n != 2, F.array(F.lit(MSG["option_count"])))
        .when(ids != F.array(F.lit("A"), F.lit("B")), F.array(F.lit(MSG["option_ids"])))
        .otherwise(F.filter(per_option, lambda m: m.isNotNull()))
    )


def quality_issues(
    text: Column | str,
    options: Column,
    action_structure: Column,
    has_frame: Column,
    required_values: Column | None = None,
    binary_required: Column | bool = True,
    forbidden: list[str] = (),
    min_words: int = fixed.MIN_WORDS,
) -> Column:
    """All guard messages of one realization; an empty text yields only the empty message."""
    need = F.lit(binary_required) if isinstance(binary_required, bool) else binary_required
    none = F.array().cast("array<string>")

    def check(body: Column, low: Column) -> Column:
        first = _messages(
            F.when(F.size(words(body)) < min_words, F.lit(MSG["short"].format(n=min_words))),
            F.when(body.contains("{{") | body.contains("}}"), F.lit(MSG["markers"])),
            *_forbidden(body, low, list(forbidden)),
        )
        mentions = none
        if required_values is not None:
            wanted = F.transform(required_values, lambda v: F.lower(F.replace(strip_ws(v), F.lit("_"), F.lit(" "))))
            absent = F.filter(wanted, lambda v: v.isNotNull() & (v != "") & ~F.contains(low, v))
            mentions = F.coalesce(F.transform(absent, lambda v: F.concat(F.lit(MSG["mention"]), v)), none)
        person = _messages(F.when(~_second_person(low), F.lit(MSG["person"])))
        structure = F.coalesce(strip_ws(action_structure).isin(fixed.BINARY_STRUCTURES), F.lit(False))
        frame = _messages(F.when(need & ~has_frame, F.lit(MSG["frame"])), F.when(need & ~structure, F.lit(MSG["frame_kind"])))
        every = F.array_distinct(F.concat(first, mentions, person, option_issues(options), frame))
        return F.when(body == "", F.array(F.lit(MSG["empty"]))).otherwise(every)

    return V.let(strip_ws(F.coalesce(col(text), F.lit(""))), lambda body: V.let(F.lower(body), lambda low: check(body, low)))


def scene_issues(
    text: Column | str, options: Column, has_frame: Column, binary_required: Column | bool = True
) -> Column:
    """The cheap validator: abstract wording, role play, person, decision cue, options, frame."""
    need = F.lit(binary_required) if isinstance(binary_required, bool) else binary_required

    def check(low: Column) -> Column:
        return _messages(
            F.when(contains_any(low, fixed.ABSTRACT_SCENE_MARKERS), F.lit(MSG["abstract"])),
            F.when(contains_any(low, fixed.ROLEPLAY_MARKERS), F.lit(MSG["roleplay"])),
            F.when(~_second_person(low), F.lit(MSG["immersive"])),
            F.when(~contains_any(low, fixed.DECISION_CUES), F.lit(MSG["cue"])),
        )

    wording = V.let(F.lower(strip_ws(F.coalesce(col(text), F.lit("")))), check)
    return F.concat(wording, option_issues(options), _messages(F.when(need & ~has_frame, F.lit(MSG["frame"]))))


def normalized_options(raw: Column) -> Column:
    """First two options as ``[{A, text}, {B, text}]``, or an empty array unless both are valid.

    ``raw`` is an array of VARIANT: objects with id and text, or bare texts.
    """
    def one(v: Column, i: Column) -> Column:
        default = F.when(i == 0, F.lit("A")).otherwise(F.lit("B"))
        is_object = V.kind(v).startswith("OBJECT")
        own_id = F.upper(strip_ws(V.get_text(v, "id")))
        option_id = F.when(is_object, F.coalesce(F.nullif(own_id, F.lit("")), default)).otherwise(default)
        text = F.when(is_object, V.get_text(v, "text")).otherwise(V.as_text(v))
        return F.struct(option_id.alias("id"), strip_ws(F.coalesce(text, F.lit(""))).alias("text"))

    pair = F.transform(F.slice(raw, 1, 2), one)
    good = F.array_sort(F.transform(pair, lambda o: o["id"])) == F.array(F.lit("A"), F.lit("B"))
    full = F.forall(pair, lambda o: o["text"] != "")
    none = F.array().cast("array<struct<id:string,text:string>>")
    return F.when(good & full, F.array_sort(pair)).otherwise(none)
