"""Identifier parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions import documents


def uuid_or_null(text: Column) -> Column:
    """Canonical UUID text, or null.

    Accepts the spellings common parsers take: a `urn:uuid:` prefix, braces, and hex
    digits with or without dashes.
    """
    digits = F.regexp_replace(
        F.btrim(F.regexp_replace(text, "urn:|uuid:", ""), F.lit("{}")), "-", ""
    )
    dashed = F.regexp_replace(
        F.lower(digits), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
    return F.when(digits.rlike("^[0-9A-Fa-f]{32}$"), dashed)


def uuid_value_or_null(value: Column) -> Column:
    """The same for a JSON value: anything but a string is no identifier."""
    return uuid_or_null(documents.as_string(value))


def url_key(url: Column) -> Column:
    """A deterministic row id derived from the natural key, shaped as a UUID."""
    digest = F.substring(F.sha2(url, 256), 1, 32)
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
