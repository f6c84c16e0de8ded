"""Date text to date, by ordered strptime-style formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cupboard.functions.text import SPACE, narrow_digits, strip

# Directive -> (pattern, role). Only the calendar date is kept, so times and offsets have no role.
_DIRECTIVES = {
    "%Y": (r"((?!0000)[0-9]{4})", "y"),
    "%y": (r"([0-9]{2})", "yy"),
    "%m": (r"(1[0-2]|0[1-9]|[1-9])", "m"),
    "%b": (r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", "b"),
    "%d": (r"(?: (?=[1-9](?![0-9])))?(3[01]|[12][0-9]|0[1-9]|[1-9])", "d"),
    "%H": (r"(?:2[0-3]|[01][0-9]|[0-9])", None),
    "%M": (r"(?:[0-5][0-9]|[0-9])", None),
    "%S": (r"(?:6[01]|[0-5][0-9]|[0-9])", None),
    "%z": (r"(?:Z|[+-][0-9]{2}:?[0-5][0-9](?::?[0-5][0-9](?:\.[0-9]{1,6})?)?)", None),
}

_CLOCK = r"(?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:[.,][0-9]+)?)?)?"
_OFFSET = r"(?:Z|[+-][0-9]{2}(?::?[0-5][0-9](?::?[0-5][0-9](?:\.[0-9]+)?)?)?)?"
_ISO = rf"(?s)^((?!0000)[0-9]{{4}})(-?)([0-9]{{2}})\2([0-9]{{2}})(?:.{_CLOCK}{_OFFSET})?$"


def _rewrite(text: Column, fmt: str) -> Column:
    """The date of a text that is wholly of one format, else NULL."""
    pattern, roles = "", []
    for part in re.findall(r"%.|\s+|[^%\s]+", fmt):
        if part.isspace():
            pattern += SPACE + "+"
        elif part.startswith("%"):
            fragment, role = _DIRECTIVES[part]
            pattern += fragment
            if role:
                roles.append(role)
        else:
            pattern += re.sub(r"([^\w])", r"\\\1", part)
    group = {role: f"${i}" for i, role in enumerate(roles, 1)}
    year = group["y"] if "y" in group else "20" + group["yy"]
    month = group["m"] if "m" in group else group["b"]
    pattern = f"(?iU)^{pattern}$"
    plain = F.regexp_replace(text, pattern, f"{year}-{month}-{group['d']}")
    # Texts of another format never reach the conversion: a failing date parser costs far more than a pattern.
    date = F.when(text.rlike(pattern), plain.try_cast("date") if "m" in group else F.try_to_date(plain, "yyyy-MMM-d"))
    if "yy" in group:  # two-digit years 69-99 belong to the 1900s
        date = F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date)
    return date


def iso_date(text: Column) -> Column:
    """Date part of an ISO date or date-time, as written: an offset never moves the day."""
    return F.when(text.rlike(_ISO), F.regexp_replace(text, _ISO, "$1-$3-$4").try_cast("date"))


def date_text(raw: Column) -> Column:
    """Trimmed text with plain digits, as the patterns expect it."""
    return narrow_digits(strip(raw))


def parse_clean_date(text: Column, formats: list[str], iso_fallback: bool = True) -> Column:
    """``parse_date`` of a text that is cleaned already; best given a column, since each format reads it."""
    tries = [_rewrite(text, fmt) for fmt in formats]
    if iso_fallback:
        tries.append(iso_date(text))
    return F.coalesce(*tries)


def parse_date(raw: Column, formats: list[str], iso_fallback: bool = True) -> Column:
    """First format that takes the whole trimmed text, then ISO, else NULL."""
    return parse_clean_date(date_text(raw), formats, iso_fallback)


def shift_months(day: Column, months: int) -> Column:
    """Month shift that overflows instead of clamping: 31 August minus 6 months is 3 March."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), months), F.dayofmonth(day) - 1)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two timestamps."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)
