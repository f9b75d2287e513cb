"""All registered queries of the evaluation engine."""

from __future__ import annotations

from evalkiln.plans import queries_data, queries_models, queries_predictions, queries_scores, queries_space  # noqa: F401  they register themselves
from evalkiln.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
