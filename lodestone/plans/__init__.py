"""Importing this package registers every query."""

from lodestone.plans import dashboards, files, metadata, reports, search, stores  # noqa: F401
from lodestone.plans.registry import ORACLES, PLANS  # noqa: F401
