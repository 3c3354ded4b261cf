"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.operators.steps import written

# A side is broadcast only after a bounded count proved it has at most this many rows.
BROADCAST_ROWS = 200_000
SALTS = 64
# A key with more rows than this in the large frame is spread over the salts.
HOT_ROWS = 100_000
_SALT, _HOT = "__salt", "__hot"


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once.

    The optimizer copies an expression into every filter pushed past it. One row exploded
    to one row stops that, which pays for expressions costing more than a row copy. What is
    exploded is a column already: a generator's own expressions are interpreted.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    given = df.select(*kept, packed.alias("__given"))
    exploded = given.select(*kept, F.explode(F.array("__given")).alias("__pinned"))
    return exploded.select(*kept, *[F.col("__pinned")[name].alias(name) for name in columns])


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most `rows` rows; never counts further than that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    spread_by: list[str],
    small_fits: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large frame to a lookup keyed by a possibly very hot key.

    `small_fits` is what the caller knows about the lookup: True (its size is proven, by
    construction or by `fits`) broadcasts it; False counts the large side's keys and spreads
    the few that have more than HOT_ROWS rows over the salts by `spread_by`, so a key with a
    third of all rows becomes `salts` shuffle partitions, while the lookup is replicated for
    those keys alone; None leaves it to adaptive execution, which broadcasts by the measured
    size and else splits skewed partitions. All are exact for inner, left, left_semi and
    left_anti, because each large row meets exactly one replica. A null key meets none, so
    its rows are spread however many they are.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    if small_fits is None:
        return big.join(small, on, how)
    if small_fits:
        return big.join(F.broadcast(small), on, how)
    # Written, so that both sides go by the same keys.
    counted = big.groupBy(*on).agg(F.count(F.lit(1)).alias(_HOT)).filter(F.col(_HOT) > HOT_ROWS)
    hot = F.broadcast(written(counted.select(*on, F.lit(True).alias(_HOT))))
    dealt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    apart = F.col(_HOT).isNotNull()
    for key in on:
        apart = apart | F.col(key).isNull()
    spread = big.join(hot, on, "left").withColumn(_SALT, F.when(apart, dealt).otherwise(0)).drop(_HOT)
    replicas = F.when(F.col(_HOT).isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = small.join(hot, on, "left").withColumn(_SALT, F.explode(replicas)).drop(_HOT)
    # Sizes are estimated as if nothing were replicated, so the choice is not left to them.
    return spread.join(copies.hint("merge"), [*on, _SALT], how).drop(_SALT)
