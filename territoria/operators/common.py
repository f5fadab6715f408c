"""Small shared helpers for the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str],
                 right_cols: Sequence[str] | None = None) -> Column:
    """Equi-join condition where NULL matches NULL (pandas merge semantics)."""
    right_cols = list(right_cols or cols)
    cond = F.lit(True)
    for a, b in zip(cols, right_cols):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def attach_one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row.

    Each column becomes a scalar subquery; Catalyst merges the subqueries on
    the same aggregate into one, runs it once and inlines the values as
    literals - no join and no shuffle of ``df``.
    """
    return df.withColumns({c: stats.select(c).scalar() for c in stats.columns})


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a
    machine-local one): the result survives executor loss and later stages
    read it instead of recomputing the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
