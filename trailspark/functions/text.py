"""String functions with the semantics of Python's, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() strips: Unicode blanks and the ASCII separators.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: Where str.splitlines() splits.
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(c) -> Column:
    return F.regexp_replace(c, rf"\A[{_SPACE}]+|[{_SPACE}]+\z", "")


def rstrip(c) -> Column:
    return F.regexp_replace(c, rf"[{_SPACE}]+\z", "")


def splitlines(c) -> Column:
    """Lines without their ends; a final line end starts no line."""
    parts = F.split(c, _BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def text_or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def newlines(c) -> Column:
    """Line ends as \\n, without blanks around; null is empty."""
    return strip(F.regexp_replace(text_or_empty(c), "\r\n?", "\n"))


def occurrences(text: Column, find: Column) -> Column:
    """Occurrences of ``find`` that do not overlap; of the empty string, one more than the length."""
    n = (F.length(text) - F.length(F.replace(text, find))) / F.length(find)
    return F.when(F.length(find) == 0, F.length(text) + 1).otherwise(F.when(F.length(find) > 0, n).cast("int"))


def replace_once(text: Column, find: Column, with_: Column) -> Column:
    """The patched text, or null unless ``find`` occurs exactly once."""
    return F.when((F.length(find) > 0) & (occurrences(text, find) == 1), F.replace(text, find, with_))


def sha256(c) -> Column:
    return F.sha2(c, 256)


def compact_call(tool: str | Column, payload: Column) -> Column:
    """``CALL tool {json}`` from a struct."""
    return F.concat(F.lit("CALL "), F.lit(tool) if isinstance(tool, str) else tool, F.lit(" "), F.to_json(payload))
