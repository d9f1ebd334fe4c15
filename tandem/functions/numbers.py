"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1 halves the 53 bits of a double, so that products with small integers are exact.
_HALVER = 134217729.0


def round_exact(x: Column, digits: int) -> Column:
    """Round a non-negative double as Python does: by its exact binary value, ties to even.

    ``F.round`` and ``F.bround`` first print the shortest decimal, so 1/80 (just above 0.0125) looks
    like a tie to them. Here the double is split into two halves whose products with ``2 * scale``
    are exact, which gives the true side of the tie.
    """
    scale = 10**digits
    below = F.floor(x * float(scale)).cast("double")
    spread = x * _HALVER
    high = spread - (spread - x)
    low = x - high
    tie = below * 2.0 + 1.0
    side = (high * (2.0 * scale) - tie) + low * (2.0 * scale)
    up = (side > 0) | ((side == 0) & (below % 2.0 == 1.0))
    return F.when(up, below + 1.0).otherwise(below) / float(scale)


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 as a double; null for an empty whole."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * 100.0
