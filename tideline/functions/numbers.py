"""Aggregates that hold under ANSI arithmetic, and numbers drawn by counting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of a 32-bit mixer: two rounds of shift, multiply and shift scatter a counter over all numbers below 2 ** 32.
MIX_SHIFT, MIX_FACTOR, MIX_MASK = 16, 0x45D9F3B, 0xFFFFFFFF


def mixed(x: np.ndarray) -> np.ndarray:
    """x (unsigned 64-bit, any values) as scattered numbers below 2 ** 32."""
    x = x & np.uint64(MIX_MASK)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(MIX_SHIFT))) * np.uint64(MIX_FACTOR)) & np.uint64(MIX_MASK)
    return x ^ (x >> np.uint64(MIX_SHIFT))


def mix(x: Column) -> Column:
    """The same of a column of whole numbers."""
    x = x.cast("long").bitwiseAND(F.lit(MIX_MASK))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, MIX_SHIFT)) * F.lit(MIX_FACTOR).cast("long")).bitwiseAND(F.lit(MIX_MASK))
    return x.bitwiseXOR(F.shiftright(x, MIX_SHIFT))


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's r over pairs without nulls; null where either side has no spread."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / F.when(spread > 0, spread))
