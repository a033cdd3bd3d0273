"""Deterministic pseudo-random units from an integer key.

``unit(k, mult, mod)`` is ``((k * mult) % mod) / mod`` computed as
``((k % mod) * (mult % mod)) % mod`` so the product never leaves 64-bit range,
whatever the size of ``k``.  It is used to derive domain columns from the given
tables, and the same arithmetic is written in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mod_mul(k: Column, mult: int, mod: int) -> Column:
    return ((k % F.lit(mod)) * F.lit(mult % mod)) % F.lit(mod)


def unit(k: Column, mult: int, mod: int) -> Column:
    """In [0, 1)."""
    return mod_mul(k, mult, mod) / F.lit(float(mod))


def signed_unit(k: Column, mult: int, mod: int) -> Column:
    """((k*mult % mod) - (mod-1)//2) / ((mod-1)//2): in [-1, 1] for odd ``mod``."""
    half = (mod - 1) // 2
    return (mod_mul(k, mult, mod) - F.lit(half)) / F.lit(float(half))
