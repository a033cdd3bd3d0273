"""3-vector arithmetic on columns.  Squares are ``x * x`` (never ``pow``), so the
result is the same correctly-rounded value in any IEEE engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def sq(x) -> Column:
    x = _c(x)
    return x * x


def norm3(x, y, z) -> Column:
    """sqrt(x^2 + y^2 + z^2)."""
    return F.sqrt(sq(x) + sq(y) + sq(z))


def distance3(x, y, z, ox, oy, oz) -> Column:
    """Euclidean distance from (x, y, z) to the point (ox, oy, oz)."""
    return F.sqrt(sq(_c(x) - _c(ox)) + sq(_c(y) - _c(oy)) + sq(_c(z) - _c(oz)))


def cross3(ax, ay, az, bx, by, bz) -> tuple[Column, Column, Column]:
    """a x b, component-wise."""
    ax, ay, az, bx, by, bz = map(_c, (ax, ay, az, bx, by, bz))
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
