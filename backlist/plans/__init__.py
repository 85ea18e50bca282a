"""Plan-shaping helpers: bounded broadcasts, distributed row ordinals and
exact quantiles, and plan inspection used by tests."""

from backlist.plans.guards import bounded_broadcast, MAX_BROADCAST_ROWS
from backlist.plans.ordinal import with_file_ordinal
from backlist.plans.quantiles import exact_quantiles

__all__ = ["bounded_broadcast", "MAX_BROADCAST_ROWS", "with_file_ordinal", "exact_quantiles"]
