"""Prompt templates compiled to Column expressions on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom.functions.text import strip_ws

_TOKEN = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")


def compile_template(template: str, values: dict[str, Column], allowlist: list[str]) -> tuple[Column, Column]:
    """(rendered text, warnings) for ``{{ name }}`` tokens.

    ``values`` maps dotted names to text columns (nested values as JSON text).  A token
    outside the allow-list or without a column renders empty and is reported once per row;
    so is an allow-listed name without a column.
    """
    static = [f"allowlisted template variable is unavailable: {n}" for n in dict.fromkeys(allowlist) if n not in values]
    parts: list[Column] = []
    end = 0
    for token in _TOKEN.finditer(template):
        if token.start() > end:
            parts.append(F.lit(template[end : token.start()]))
        name = token.group(1)
        if name in allowlist and name in values:
            parts.append(F.coalesce(values[name], F.lit("")))
        else:
            static.append(f"template variable is unavailable: {name}")
        end = token.end()
    parts.append(F.lit(template[end:]))
    rendered = strip_ws(F.concat(*parts))
    warnings = [F.lit(w) for w in dict.fromkeys(static)]
    return rendered, F.array(*warnings).cast("array<string>")


def choices_block(options: Column) -> Column:
    """``A. …`` / ``B. …`` lines for exactly two valid options, else null."""
    ids = F.transform(options, lambda o: F.upper(strip_ws(F.coalesce(o["id"], F.lit("")))))
    texts = F.transform(options, lambda o: strip_ws(F.coalesce(o["text"], F.lit(""))))
    valid = (
        (F.size(options) == 2)
        & F.forall(ids, lambda i: i.isin("A", "B"))
        & F.forall(texts, lambda t: t != "")
    )
    return F.when(valid, F.concat_ws("\n", F.zip_with(ids, texts, lambda i, t: F.concat(i, F.lit(". "), t))))


def append_choices(
    prompt: Column,
    options: Column,
    fallback_options: Column | None = None,
    enabled: bool = True,
    header: str = "Choices:",
    separator: str = "\n\n",
) -> Column:
    """Prompt followed by its choices block; options come from the payload, else the case metadata."""
    if not enabled:
        return prompt
    chosen = options
    if fallback_options is not None:
        chosen = F.when(F.coalesce(F.size(options), F.lit(0)) > 0, options).otherwise(fallback_options)
    block = choices_block(chosen)
    glue = separator.replace("\\n", "\n")
    lead = f"{glue}{header.strip()}\n" if header.strip() else glue
    return F.when(block.isNull(), prompt).otherwise(F.concat(prompt, F.lit(lead), block))
