"""Random numbers that depend only on (row, column, seed), not on the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = 2.0**-53


def uniform(row: Column, col: Column, seed: int, stream: int = 0) -> Column:
    """A double in [0, 1) from the top 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(row, col, F.lit(seed), F.lit(stream)), 11)
    return bits.cast("double") * _UNIT


def normal(row: Column, col: Column, seed: int) -> Column:
    """A standard normal draw (Box-Muller on two uniforms)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(row, col, seed, 1)))
    return radius * F.cos(2.0 * math.pi * uniform(row, col, seed, 2))
