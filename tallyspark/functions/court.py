"""Where a shot was taken and what it was worth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values, in feet of the half court: the rim, the straight line in the corners, the arc's radius, and the distance from which a whole-foot position counts as beyond it
RIM_X, RIM_Y = 25.0, 0.0
CORNER_X = 22.0
RADIUS = 23.75
CUTOFF = 23.5
# fixed values: seasons whose shots cannot be told apart without a label, and the last one whose texts name every three
UNTOLD = (2002,)
TOLD_UNTIL = 2012


def rim_distance(x: Column, y: Column) -> Column:
    dx, dy = x - RIM_X, y - RIM_Y
    return F.sqrt(dx * dx + dy * dy)


def has_position(x: Column, y: Column) -> Column:
    """A position is known; the origin stands for none."""
    return F.coalesce(x.isNotNull() & y.isNotNull() & ~((x == 0) & (y == 0)), F.lit(False))


def beyond_arc(x: Column, y: Column) -> Column:
    """In a corner beyond the straight line, which ends where it meets the arc, or anywhere far enough."""
    corner_y = round((RADIUS**2 - CORNER_X**2) ** 0.5, 2)
    return ((F.abs(x - RIM_X) >= CORNER_X) & (y - RIM_Y <= corner_y)) | (rim_distance(x, y) >= CUTOFF)


def shot_value(kind: Column, label: Column, text: Column, season: Column, x: Column, y: Column, untold: tuple[int, ...] = UNTOLD, told_until: int = TOLD_UNTIL) -> Column:
    """1, 2 or 3, by the first of these that tells: a free throw's type, a label of 2 or 3, the text, the season's rule, the position; null where none does."""
    says = lambda t: F.coalesce(text.ilike(f"%{t}%"), F.lit(False))
    value = F.when(F.coalesce(kind.ilike("%free throw%"), F.lit(False)), 1).when(label.isin(2, 3), label).when(says("three point"), 3).when(says("two point"), 2)
    value = value.when(season.isin(*untold), None) if untold else value
    return value.when(season <= told_until, 2).when(~has_position(x, y), None).when(beyond_arc(x, y), 3).otherwise(2).cast("int")
