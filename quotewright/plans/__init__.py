"""Queries over the given tables. Importing this package registers all of them."""

from quotewright.plans import content, pricing, records, streams  # noqa: F401
from quotewright.plans.registry import ORACLES, QUERIES  # noqa: F401
