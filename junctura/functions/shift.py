"""How far an insertion or deletion can move without changing the sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _extent(context: Column, event: Column) -> Column:
    """Length of the longest beginning of context that repeats event cyclically."""
    n = F.length(context)
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(context, i, 1) == F.substring(event, 1 + (i - 1) % F.length(event), 1))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1)


def right_shift(after: Column, event: Column) -> Column:
    return _extent(after, event)


def left_shift(before: Column, event: Column) -> Column:
    return _extent(F.reverse(before), F.reverse(event))
