"""Unicode-aware trimming and digit handling, inside the JVM."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMALS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None]
WIDE_DIGITS = "".join(_DECIMALS)
_NARROW_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _DECIMALS)

WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# One Unicode whitespace character, for use under the (?U) flag.
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (plain ``trim`` removes U+0020 only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def narrow_digits(text: Column) -> Column:
    """Write every decimal digit as 0-9; text in ASCII passes untouched."""
    return F.when(
        text.rlike(r"[^\x00-\x7f]"), F.translate(text, WIDE_DIGITS, _NARROW_DIGITS)
    ).otherwise(text)


def python_float(text: Column) -> Column:
    """Number spelled as a decimal literal, else NULL; never the Java-only forms such as ``1d``."""
    plain = narrow_digits(strip(text))
    digits = r"[0-9]+(?:_[0-9]+)*"
    literal = rf"^[+-]?(?:(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?|(?i:inf(?:inity)?))$"
    return F.when(plain.rlike(literal), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def row_json(names: Column, cells: Column) -> Column:
    """A row as a JSON object: nulls kept, non-ASCII kept, header order kept."""
    return F.to_json(F.map_from_arrays(names, cells), {"ignoreNullFields": "false"})


def like(column: str, pattern: str) -> Column:
    """LIKE with cases folded. The pattern language has no escape character, so a backslash stands for itself."""
    return F.col(column).ilike(pattern.replace("\\", "\\\\"))
