"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *keep: str, **new: Column) -> DataFrame:
    """df's columns `keep` and new ones, which later plans read and don't work out again.

    A projection that others refer to several times is merged into them, and an expensive expression then runs once for
    each use, inside a lambda even once for each element. The rows of a generator aren't merged.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in new.items())))))
