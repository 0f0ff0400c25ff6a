"""Shares, intervals and axis arithmetic as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(n: Column, of: Column) -> Column:
    """100 n / of; null if either is missing or ``of`` is zero."""
    return F.try_divide(100.0 * n, of.cast("double"))


def wilson(x: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's score interval of a share, in percent, from 0 to 100."""
    n = n.cast("double")
    share = F.try_divide(x.cast("double"), n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (share + F.try_divide(F.lit(z * z), 2 * n)) / scale
    margin = F.lit(z) / scale * F.sqrt(F.try_divide(share * (1 - share), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    clip = lambda v: F.when(v.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * v)))
    return clip(centre - margin), clip(centre + margin)


def axis_cap(top: Column) -> Column:
    """The next multiple of five, at most 100."""
    return F.least(F.lit(100.0), F.ceil(top / 5) * 5.0)
