"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div0(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b as double; a quotient that is not finite becomes default."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), F.lit(default)).otherwise(q)


def mean0(total: Column, n: Column) -> Column:
    """Mean over n members of which only the non-zero ones are in the sum."""
    return div0(total, n)


def var0(total: Column, squares: Column, n: Column) -> Column:
    """Population variance over n members from the sums of the non-zero ones; never below 0."""
    mean = div0(total, n)
    return F.greatest(F.lit(0.0), div0(squares, n) - mean * mean)


def clip(x: Column, low: Column | float | None, high: Column | float | None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    if low is not None:
        x = F.greatest(x, lit(low))
    return x if high is None else F.least(x, lit(high))


def strip_version(accession: Column) -> Column:
    return F.substring_index(accession, ".", 1)


def tenx(name: Column) -> Column:
    """Sample names that begin with TenX begin with 10X in metadata tables."""
    return F.regexp_replace(name, "^TenX", "10X")
