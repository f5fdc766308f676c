"""All registered queries of the engine: importing this module fills the table."""

from ruleloom.plans import q_evaluation, q_features, q_mining, q_pipelines, q_ranking, q_sampling, q_scalars, q_sources  # noqa: F401
from ruleloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
