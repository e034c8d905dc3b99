"""All registered queries."""

from pulsegrid.plans import q_aggregates, q_align, q_columns, q_evaluation, q_models, q_scoring, q_series, q_shape, q_stream, q_windows  # noqa: F401
from pulsegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
