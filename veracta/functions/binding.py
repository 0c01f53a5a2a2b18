"""Names for what an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once and stands in the plan once, however often ``body`` uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]
