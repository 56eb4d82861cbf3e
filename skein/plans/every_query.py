"""All registered queries: importing a module of queries registers them."""

from skein.plans import analytics, code_graph, configurations, exchange, hybrid_plans, monitoring, retrieval, streams, trees  # noqa: F401
from skein.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
