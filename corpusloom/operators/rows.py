"""Row functions that no expression can state, sent to Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(fn: Callable, kind: str) -> Callable[..., Column]:
    """fn as a column function of the given SQL type; a null first argument gives null."""

    def guarded(first, *rest):
        return None if first is None else fn(first, *rest)

    return F.udf(guarded, kind, useArrow=True)


def packed(units: Sequence[str], limit: int, count: Callable[[str], int], glue: str = "") -> list[str]:
    """Consecutive units, as many in each string as the limit allows; a unit over the limit stands alone."""
    starts = [0]
    for i in range(1, len(units)):
        if count(glue.join(units[starts[-1] : i + 1])) > limit:
            starts.append(i)
    return [glue.join(units[a:b]) for a, b in pairwise([*starts, len(units)])] if units else []
