"""Text helpers as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom import fixed

# White space as Unicode text handling counts it, control separators included.
WS = r"\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Bytes of text that a Python worker turns into objects at a time.
SLICE_BYTES = 1 << 20
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Ends trimmed of every white-space character; looks at the ends only, no pattern."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def blank_to_null(c: Column | str) -> Column:
    """Null for null, empty and white-space-only text; stripped text otherwise."""
    return F.nullif(strip_ws(c), F.lit(""))


def first_truthy(*cols: Column | str) -> Column:
    """First value that is neither null nor empty (``a or b or …`` on text)."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


def by_slices(convert):
    """``convert`` (list of texts to an Arrow array) over a batch of texts, some ``SLICE_BYTES`` of them at a time.

    A batch holds as many rows as the session says, whatever their length, and Python objects
    take a multiple of its bytes: a worker's memory is that of the batch and its result.
    """
    limit = SLICE_BYTES

    def run(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return convert([])
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        starts = np.unique(ends // limit, return_index=True)[1].tolist()
        spans = zip(starts, [*starts[1:], len(texts)], strict=True)
        return pa.concat_arrays([convert(texts.slice(a, b - a).to_pylist()) for a, b in spans])

    return run


def _normalizer():
    # Defined inside a function so that it is shipped by value and the executors
    # need no copy of this package.
    def normalize(texts: list) -> pa.Array:
        plain = (s if s is None or s.isascii() else unicodedata.normalize("NFKC", s) for s in texts)
        return pa.array([s if s is None else " ".join(s.split()) for s in plain], pa.string())

    # Said not to be deterministic, or a filter on the result would be pushed below it and get
    # a second run of it, with a Python worker of its own.
    return F.arrow_udf(by_slices(normalize), T.StringType()).asNondeterministic()


def normalize_text(c: Column | str) -> Column:
    """NFKC, white-space runs to one blank, ends trimmed.

    Spark has no expression for NFKC, so this runs over Arrow batches; the blanks are
    handled in the same pass.
    """
    return _normalizer()(col(c))


def infer_language(c: Column | str) -> Column:
    return F.when(col(c).rlike(fixed.CJK_RANGES), "zh").otherwise("en")


def language_alias(c: Column | str) -> Column:
    """Known spellings to a language code, other values kept, blank to ``en``."""
    low = F.lower(strip_ws(c))
    out = None
    for code, names in fixed.LANGUAGE_ALIASES.items():
        cond = low.isin(names)
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out.otherwise(F.coalesce(F.nullif(low, F.lit("")), F.lit("en")))


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), f"[{WS}]+"), lambda w: w != "")


def lines(c: Column | str) -> Column:
    return F.split(col(c), LINE_BREAK)


def path_component(c: Column | str) -> Column:
    """Value usable as one directory name; blank becomes ``unknown``."""
    safe = strip_ws(F.translate(F.coalesce(col(c), F.lit("")), "\\/:\n", "____"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown"))


def slug(c: Column | str) -> Column:
    """Lower case, every character that is no letter or digit becomes ``_``; blank becomes ``item``."""
    low = F.regexp_replace(F.lower(strip_ws(c)), r"[^\p{L}\p{N}]", "_")
    return F.coalesce(F.nullif(F.btrim(low, F.lit("_")), F.lit("")), F.lit("item"))


def contains_any(c: Column | str, needles: list[str]) -> Column:
    """OR of plain substring tests; case is the caller's business."""
    out = F.lit(False)
    for needle in needles:
        out = out | col(c).contains(needle)
    return out


def digits(n: Column, width: int) -> Column:
    """Zero-padded number that grows beyond ``width`` instead of being cut."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def java_pattern(pattern: str) -> str:
    """A Python pattern with its named groups spelled as Java has them; underscores, which Java names lack, become ``U``."""
    name = lambda m: m[1].replace("_", "U")
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{name(m)}>", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{name(m)}>", pattern)


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """Why Spark cannot use the pattern, or None; a constant expression, so no task runs."""
    try:
        spark.sql("select '' rlike :p", args={"p": pattern}).collect()
    except Exception as exc:  # noqa: BLE001 - any complaint is the answer
        return str(exc).splitlines()[0]
    return None
