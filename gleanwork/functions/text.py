"""Text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.schemas import UNSPECIFIED


def snippet(markdown: Column, limit: int = 240) -> Column:
    """The first characters of a description with its markdown markup removed."""
    # The three patterns decide which characters a snippet shows.
    plain = F.regexp_replace(markdown, r"\[([^\]]*)\]\([^)]*\)", "$1")
    # Underscores mark emphasis only where no word character stands on both sides.
    plain = F.regexp_replace(plain, r"(?U)[#*`>]+|(?<!\w)_+|_+(?!\w)", "")
    plain = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    return F.substring(plain, 1, limit)


# A number this long is beyond what `int` reads.
_LONG_REFERENCE = re.compile("&#([0-9]{1000,});?")


def readable_references(text: str) -> str:
    """The text with over-long numeric character references shortened or, where they name
    no character, replaced as the decoder would."""

    def short(found: re.Match) -> str:
        digits = found[1].lstrip("0")
        return f"&#{digits or 0};" if len(digits) < 8 else "\ufffd"

    return _LONG_REFERENCE.sub(short, text) if "&#" in text else text


@F.arrow_udf(T.StringType())
def unescape(texts):
    """Decode every HTML entity once (the full table needs a Python worker)."""
    import html

    import pyarrow as pa

    return pa.array([None if t is None else html.unescape(readable_references(t)) for t in texts.to_pylist()], pa.string())


def humanize_key(key: Column) -> Column:
    spaced = F.trim(F.replace(key, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def relative_time(at: Column, now: Column) -> Column:
    """`Nm ago`, `Nh ago` or `Nd ago`, halves rounded up."""
    millis = F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))
    minutes = F.floor(millis / 60000.0 + 0.5)
    hours = F.floor(minutes / 60.0 + 0.5)
    days = F.floor(hours / 24.0 + 0.5)
    return (
        F.when(minutes < 60, F.concat(F.greatest(minutes, F.lit(0)).cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def facet_label(value: Column) -> Column:
    return F.when(value == UNSPECIFIED, F.lit("Unspecified")).otherwise(value)


def strip_fences(text: Column) -> Column:
    """Drop a leading and a trailing fence line; the result ends with one newline."""
    lines = F.split(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""), r"\r\n|\r|\n")
    opened = F.when(
        F.startswith(F.element_at(lines, 1), F.lit("```")),
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
    ).otherwise(lines)
    closed = F.when(
        F.coalesce(F.startswith(F.try_element_at(opened, F.lit(-1)), F.lit("```")), F.lit(False)),
        F.slice(opened, F.lit(1), F.size(opened) - 1),
    ).otherwise(opened)
    return F.concat(F.regexp_replace(F.array_join(closed, "\n"), r"(?U)^\s+|\s+\z", ""), F.lit("\n"))


def head_budget(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def decode_body(body: Column) -> Column:
    """JSON bytes as text, by byte-order mark or the zero-byte pattern of the first
    characters, never by a declared charset.
    """
    start = F.hex(F.substring(body, 1, 4))
    pad = F.rpad(start, 8, "F")

    def as_text(charset: str) -> Column:
        return F.decode(body, charset)

    return (
        F.when(F.startswith(start, F.lit("0000FEFF")), as_text("UTF-32"))
        .when(F.startswith(start, F.lit("FFFE0000")), as_text("UTF-32"))
        .when(F.startswith(start, F.lit("FEFF")) | F.startswith(start, F.lit("FFFE")), as_text("UTF-16"))
        .when(F.startswith(start, F.lit("EFBBBF")), F.try_validate_utf8(F.substring(body, F.lit(4), F.octet_length(body)).cast("string")))
        .when(pad.rlike("^000000"), as_text("UTF-32"))
        .when(pad.rlike("^00"), as_text("UTF-16BE"))
        .when(pad.rlike("^..000000"), F.decode(F.concat(F.unhex(F.lit("FFFE0000")), body), "UTF-32"))
        .when(pad.rlike("^..00"), as_text("UTF-16LE"))
        .otherwise(F.try_validate_utf8(body.cast("string")))
    )
