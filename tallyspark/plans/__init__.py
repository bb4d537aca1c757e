"""Report shapes, and every operator bound to the verification tables."""

from . import changes, derived, figures, loads, narrowings, reports, rules  # noqa: F401
from .bind import ORACLES, QUERIES  # noqa: F401
