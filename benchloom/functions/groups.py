"""Group selectors over case rows, and the group key of a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom.functions import variants as V

_VARIANT_SCOPES = ("metadata", "execution_hints", "evaluation_hints")


def case_id_prefix(case_id: Column | str) -> Column:
    """Case id without a trailing ``_<digits>``."""
    c = F.col(case_id) if isinstance(case_id, str) else case_id
    prefix = F.regexp_extract(c, r"^(.+)_\d+$", 1)
    return F.coalesce(F.nullif(prefix, F.lit("")), c)


def group_value(selector: str | None) -> Column:
    """Column for a selector; null and empty become ``ungrouped``, an unknown selector is an error."""
    if selector in (None, "", "all"):
        return F.lit("all")
    if selector in ("case_id", "split"):
        return F.col(selector)
    if selector == "case_id_prefix":
        return case_id_prefix("case_id")
    if selector == "metadata":
        return _or_ungrouped(V.as_text(F.col("metadata")))
    scope, _, key = selector.partition(".")
    if key and scope == "grouping":
        return _or_ungrouped(F.try_element_at(F.col("grouping"), F.lit(key)))
    if key and scope in _VARIANT_SCOPES:
        return _or_ungrouped(V.get_text(scope, key))
    raise ValueError(f"unsupported group selector: {selector}")


def _or_ungrouped(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("ungrouped"))


def truthy_text(obj: Column | str, key: str) -> Column:
    """Text of a key, null when the value is empty, zero, false or an empty container."""

    def solid(v: Column) -> Column:
        zero = V.kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(v, "$", "double") == 0)
        text = V.as_text(v)
        return F.when(~(F.coalesce(zero, F.lit(False)) | text.isin("", "False", "[]", "{}")), text)

    return V.let(V.get(obj, key), solid)


def result_group_key(metadata: Column | str = "metadata", prompt_metadata: Column | str = "prompt_metadata") -> Column:
    """Group of a target result: group, variant group, family or template id, else ``default``."""
    keys = ("group_key", "variant_group_id", "family_id", "template_id")
    return F.coalesce(
        *[truthy_text(metadata, k) for k in keys], *[truthy_text(prompt_metadata, k) for k in keys], F.lit("default")
    )


def result_family(metadata: Column | str = "metadata", prompt_metadata: Column | str = "prompt_metadata") -> Column:
    keys = ("family_id", "template_id")
    return F.coalesce(
        *[truthy_text(metadata, k) for k in keys], *[truthy_text(prompt_metadata, k) for k in keys], F.lit("default")
    )


def split_value(prompt_metadata: Column, split: Column) -> Column:
    """Split of a dataset record: prompt metadata, then the record, else ``unspecified``."""
    from benchloom.functions.text import blank_to_null

    return F.coalesce(blank_to_null(V.get_text(prompt_metadata, "split")), blank_to_null(split), F.lit("unspecified"))
