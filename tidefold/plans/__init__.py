"""All queries of the engine's own operators, by name, with their SQL."""

from tidefold.plans import dag, folds, functions, read_models, scheduling, streams, sweeps  # noqa: F401  they register themselves
from tidefold.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
