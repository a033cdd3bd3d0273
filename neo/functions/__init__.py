"""Column-expression builders.  Everything here returns a ``Column`` made only
of built-in Spark functions, so it stays inside whole-stage codegen."""

from neo.functions.vector import cross3, distance3, norm3, sq  # noqa: F401
from neo.functions.risk import (  # noqa: F401
    classify_orbit, map_marker_color, map_marker_size, risk_color, risk_ladder,
)
from neo.functions.timefn import epoch_seconds, iso_string, to_ntz  # noqa: F401
