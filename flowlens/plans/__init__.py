"""Registered queries over the driver tables."""

from flowlens.plans import cleaning, decisions, detection, loading, metrics, online, samples  # noqa: F401
from flowlens.plans.flagship import flagship  # noqa: F401
from flowlens.plans.registry import ORACLES, QUERIES  # noqa: F401
