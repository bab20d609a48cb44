"""Expressions used more than once become columns of their own first, so that they are planned and evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, parts: dict[str, Column], prefix: str) -> tuple[DataFrame, dict[str, Column]]:
    """(df with a column prefix+name for every part, the same parts as references to those columns)."""
    return df.withColumns({f"{prefix}{n}": c for n, c in parts.items()}), {n: F.col(f"{prefix}{n}") for n in parts}


def unstaged(df: DataFrame, *prefixes: str) -> DataFrame:
    """df without the helper columns."""
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])
