"""Evaluating a shared expression once.

The optimizer may copy a column's expression to each place that uses it. For long expressions which are used
many times, that makes plans explode; these helpers bind the value first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is worked out once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` plus columns that later steps read as they are: a generator of one row stands between."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
