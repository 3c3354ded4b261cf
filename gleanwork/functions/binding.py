"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """Bind a value once and use it several times inside an expression.

    A Column used twice is an expression written twice: conditional branches are not
    deduplicated, so nested uses multiply. A one-element transform evaluates it once.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))
