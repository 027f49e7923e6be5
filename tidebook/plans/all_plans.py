"""All queries of the analytics package."""

from tidebook.plans import compound_plans, graph_plans, ingest_plans, market_plans, quality_plans, signal_plans, stream_plans  # noqa: F401
from tidebook.plans.registry import ORACLES, QUERIES  # noqa: F401
