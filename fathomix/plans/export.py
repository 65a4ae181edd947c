"""Subset export: constraints, chosen variables, optional distinct rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from fathomix.operators.columns import check_columns
from fathomix.operators.constraints import Bounds
from fathomix.plans.plotdata import constrained


def export_subset(
    observations: DataFrame,
    coverage: DataFrame,
    variables: Sequence[str] | None = None,
    bounds: Bounds | None = None,
    distinct: bool = False,
    as_of: Column | None = None,
) -> DataFrame:
    """Rows of all datasets inside their bounds, all columns or only the named ones."""
    if variables:
        check_columns(observations.columns, variables)
    rows = constrained(observations, coverage, bounds, as_of)
    chosen = rows.select(*variables) if variables else rows
    return chosen.distinct() if distinct else chosen
