"""All registered queries."""

from tallyframe.plans import q_draws, q_jobs, q_models, q_priors, q_scalars, q_scores, q_tables  # noqa: F401
from tallyframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
