"""Fail-closed checks in a lazy engine.

Each constraint is a DataFrame of its violations. ``strict`` is the action that raises when there is one; it runs
before the checked result is used, and is never hidden in a projection that the optimiser might prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


class CheckError(ValueError):
    """A constraint doesn't hold; ``code`` is stable, ``rows`` are the first violations."""

    code = "validation"

    def __init__(self, message: str, rows: list | None = None):
        super().__init__(f"{self.code}: {message}")
        self.rows = rows or []


class OofLeakage(CheckError):
    code = "oof_leakage"


class OofValidation(CheckError):
    code = "oof_validation"


class CampaignValidation(CheckError):
    code = "campaign_validation"


class GraphValidation(CheckError):
    code = "graph_validation"


class RelationValidation(CheckError):
    code = "relation_validation"


def strict(violations: DataFrame, error: type[CheckError], message: str, shown: int = 20) -> None:
    """Raise ``error`` if ``violations`` has a row; only the first few reach the driver."""
    rows = violations.limit(shown).collect()
    if rows:
        raise error(f"{message}: {[r.asDict() for r in rows]}", rows)
