"""Strict mode: rows whose error is known become an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict(rows: DataFrame, error_col: str = "error") -> DataFrame:
    """``rows``, failing with the text of ``error_col`` at any row that has one, whatever is asked of the result.

    The check is a filter, so that no column pruning removes it (a count fails as well).  Its predicate is
    not deterministic, so the optimizer neither merges it with later filters nor moves them before it.  (A plan
    that needs no row at all, as a join with an empty table, still checks none.)
    """
    return rows.where(passes(F.col(error_col)))


def passes(error: Column) -> Column:
    """True, or the exception."""
    barrier = F.monotonically_increasing_id() >= 0
    return barrier & F.when(error.isNull(), F.lit(True)).otherwise(F.raise_error(error).cast("boolean"))
