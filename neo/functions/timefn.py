"""Time columns that accept ISO strings, ``timestamp_ntz`` and ``timestamp``.

Strings are read with ``try_cast`` to ``timestamp_ntz``: both the form with six
fraction digits and the form without fraction parse, an unreadable string gives
null instead of an error (ANSI mode stays on).  Epoch seconds are computed from
wall-clock fields, so the result does not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The offset at the end of a timestamp text.
OFFSET = r"(Z|(?<=:\d\d(\.\d{1,9})?)[+-]\d\d:?\d\d)$"

#: Epoch seconds of the end of the year 9999, the last that a timestamp holds.
LAST_SECOND = 253402300800


def to_ntz(df: DataFrame, name: str) -> Column:
    """The column ``name`` of ``df`` as ``timestamp_ntz`` (null when unreadable); a text with an
    offset (``Z``, ``+05:00``) is converted to UTC."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.TimestampNTZType):
        return c
    if isinstance(dt, T.TimestampType):
        return c.cast(T.TimestampNTZType())
    offset = F.regexp_extract(c, OFFSET, 0)
    plain = F.regexp_replace(c, OFFSET, "").try_cast("timestamp_ntz")
    minutes = (F.substring(offset, 2, 2).try_cast("int") * F.lit(60)
               + F.regexp_replace(F.substring(offset, 4, 3), ":", "").try_cast("int"))
    east = F.when(F.length(offset) <= 1, F.lit(0)).when(offset.startswith("-"), -minutes).otherwise(minutes)
    return F.timestamp_add("MINUTE", -east, plain)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 00:00:00 of a ``timestamp_ntz`` (floor)."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(86400)
            + F.hour(ts) * F.lit(3600) + F.minute(ts) * F.lit(60) + F.second(ts)).cast("bigint")


def iso_string(ts: Column) -> Column:
    """ISO-8601 text with six fraction digits, the publisher's format.

    A ``timestamp_ntz`` cast to text keeps its wall-clock fields whatever the
    session time zone (``date_format`` would pass it through the session zone
    and move times that fall in a daylight-saving gap); the text is then put in
    the fixed six-digit form: "yyyy-MM-dd HH:mm:ss[.f]" -> "yyyy-MM-ddTHH:mm:ss.ffffff".
    """
    text = ts.cast("string")
    fraction = F.substring(text, 21, 6)
    return F.when(ts.isNotNull(), F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8),
                                           F.lit("."), F.rpad(fraction, 6, "0")))


def add_seconds(ts: Column, seconds: Column) -> Column:
    """``ts`` plus a (fractional, non-negative) number of seconds, at microsecond
    resolution (fraction below a microsecond is dropped); null beyond the year 9999."""
    fits = (seconds >= F.lit(0.0)) & (epoch_seconds(ts) + seconds < F.lit(float(LAST_SECOND - 1)))
    seconds = F.when(fits, seconds)
    micros = F.floor(seconds * F.lit(1000000.0)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, ts)
