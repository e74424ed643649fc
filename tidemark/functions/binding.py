"""A name for an expression that is used several times.

Columns are trees: an expression that is used twice is there twice, and twice as large at every level above. Bound
to the variable of a lambda it is there once and is evaluated once for each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once. Not for aggregates, windows or subqueries."""
    return F.element_at(F.transform(F.array(value), body), 1)
