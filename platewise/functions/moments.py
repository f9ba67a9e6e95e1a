"""Spread aggregates that are exactly zero on constant columns.

Merging partial variances of equal values leaves a rest of rounding that depends on the number
of partitions; minimum and maximum do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _constant(c: Column) -> Column:
    return (F.min(c) == F.max(c)) & ~F.isnan(F.max(c.cast("double")))


def _spread(c: Column | str, of, least: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(_constant(c), F.when(F.count(c) >= least, F.lit(0.0))).otherwise(of(c))


def var_pop(c: Column | str) -> Column:
    return _spread(c, F.var_pop, 1)


def var_samp(c: Column | str) -> Column:
    return _spread(c, F.var_samp, 2)


def stddev_pop(c: Column | str) -> Column:
    return _spread(c, F.stddev_pop, 1)


def stddev_samp(c: Column | str) -> Column:
    return _spread(c, F.stddev_samp, 2)
