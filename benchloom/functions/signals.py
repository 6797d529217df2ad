"""Signals read from a reply text: refusal, decision, confidence, simple features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom import fixed

from benchloom.functions.text import LINE_BREAK, blank_to_null, col, contains_any, lines, strip_ws, words
from benchloom.functions.variants import let


def refusal(reply: Column | str, markers: list[str] | None = None, blank_is_refusal: bool = True) -> Column:
    """True when a marker occurs in the lower-cased text; optionally for blank text too."""
    text = F.coalesce(col(reply), F.lit(""))
    hit = let(F.lower(text), lambda low: contains_any(low, fixed.REFUSAL_MARKERS if markers is None else markers))
    return (blank_to_null(text).isNull() | hit) if blank_is_refusal else hit


def structural_refusal(reply: Column | str) -> Column:
    return refusal(reply, fixed.STRUCTURAL_REFUSAL_MARKERS, blank_is_refusal=False)


def first_line(reply: Column | str) -> Column:
    """First line of the stripped text, cut at the fixed length; null when blank."""
    head = F.element_at(F.split(blank_to_null(reply), LINE_BREAK, 2), 1)
    return F.substring(strip_ws(head), 1, fixed.FIRST_LINE_CHARS)


def without_thinking(reply: Column | str) -> Column:
    """Text with thinking, analysis and reasoning blocks removed."""
    out = col(reply)
    for tag in ("thinking", "analysis", "reasoning"):
        out = F.regexp_replace(out, f"(?isu)<{tag}>.*?</{tag}>", "")
    return strip_ws(out)


def first_visible_line(reply: Column | str) -> Column:
    """First non-blank line outside thinking blocks."""
    visible = F.filter(F.transform(lines(without_thinking(reply)), strip_ws), lambda x: x != "")
    return F.substring(F.get(visible, F.lit(0)), 1, fixed.FIRST_LINE_CHARS)


def decision(reply: Column | str, choice: Column | None = None, answer: Column | None = None, text: Column | None = None) -> Column:
    """Parsed choice, answer or text when given, else the first line."""
    given = [blank_to_null(c) for c in (choice, answer, text) if c is not None]
    return F.coalesce(*given, first_line(reply))


def confidence(reply: Column | str) -> Column:
    """Struct(value, label): the number after "confidence", else the first word of the fixed list present."""

    def read(low: Column) -> Column:
        # Plain tests come first; most texts never reach a pattern.
        number = F.when(
            low.contains("confidence"), F.nullif(F.regexp_extract(low, r"(?U)\bconfidence\b[:\s]+([0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
        )
        label = F.coalesce(*[F.when(low.contains(w) & low.rlike(rf"(?U)\b{w}\b"), F.lit(w)) for w in fixed.CONFIDENCE_WORDS])
        pair = lambda n: F.struct(n.cast("double").alias("value"), F.when(n.isNull(), label).alias("label"))
        return let(number, pair)

    return let(F.lower(col(reply)), read)


def features(reply: Column | str, comparison: str = r"\b(option|choice|compare)\b") -> Column:
    """Struct(chars, words, compares)."""
    return F.struct(
        F.char_length(col(reply)).cast("bigint").alias("chars"),
        F.size(words(reply)).cast("bigint").alias("words"),
        col(reply).rlike("(?iU)" + comparison).alias("compares"),
    )
