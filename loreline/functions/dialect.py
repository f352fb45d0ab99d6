"""Regular-expression and string conventions: Unicode words, blanks and line ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
BLANK = r"[\s\x1C-\x1F]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
UPPER = r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}]"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def split_lines(c: Column) -> Column:
    """Lines without their ends; a line end at the close opens no further line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def rx_quote(c: Column) -> Column:
    """Quoted for use inside a pattern."""
    return F.regexp_replace(c, r"([\\.^$|()\[\]{}*+?-])", r"\\$1")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
