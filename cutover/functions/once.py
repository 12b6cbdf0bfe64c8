"""Evaluate expensive expressions once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Like ``withColumns``, but the optimizer cannot copy the expressions to where they are used.

    A projection is merged into the filters and projections above it, which
    may repeat a costly expression once per use.  Unpacking a one-element
    array keeps the row count and stops the merge.
    """
    return df.select("*", F.inline(F.array(F.struct(*(x.alias(n) for n, x in columns.items())))))
