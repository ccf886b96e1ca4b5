"""Named queries over the test tables, each with its SQL counterpart where SQL can state it."""

from inkprint.plans import corpus_plans, io_plans, model_plans, text_plans, vector_plans  # noqa: F401  (they register their queries)
from inkprint.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
