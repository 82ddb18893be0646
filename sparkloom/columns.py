"""Small column helpers that operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names(keys: str | Iterable[str]) -> list[str]:
    """One name or several as a list."""
    return [keys] if isinstance(keys, str) else list(keys)


def require(df: DataFrame, *columns: str) -> None:
    """Raise ValueError if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def peptide_key(column: str | Column) -> Column:
    """Compared form of a peptide sequence: without blanks at both ends, upper case; null if nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    clean = F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(clean != "", clean)


def real(column: str | Column) -> Column:
    """The value, with NaN turned to null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition on equal keys where null equals null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond
