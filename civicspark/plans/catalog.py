"""All registered queries: importing the sections fills the registry."""

from civicspark.plans import (  # noqa: F401
    queries_aggregates,
    queries_ecological,
    queries_fairness,
    queries_geo,
    queries_incremental,
    queries_joins,
    queries_models,
    queries_predicates,
    queries_scalars,
    queries_sources,
    queries_tables,
)
from civicspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
