"""Distances and posteriors that need the gamma function, as Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .grid import Grid


def _lgamma(a: np.ndarray) -> np.ndarray:
    """Log gamma of an array. A plain function: functions that use it are pickled by value."""
    a = np.asarray(a, float)
    return np.fromiter(map(math.lgamma, a.ravel().tolist()), float, a.size).reshape(a.shape)


def _pairs(f):
    """A pandas UDF over two array columns from a function of two matrices, row by row vectors; null for a null.

    Rows are stacked by the length of their vectors, so f sees whole matrices.
    """

    @pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        sound = [a is not None and b is not None for a, b in zip(x, y, strict=True)]
        length = np.array([len(a) if ok else -1 for a, ok in zip(x, sound, strict=True)])
        for n in np.unique(length[length >= 0]):
            at = np.flatnonzero(length == n)
            p, q = (np.array([s.iloc[i] for i in at], float).reshape(len(at), n) for s in (x, y))
            out[at] = f(p, q)
        return pd.Series(out).where(pd.Series(sound), None)

    return run


def stabilised_minkowski(x: Column, y: Column, n: float = 5000.0, p: float = 10.0) -> Column:
    """Minkowski distance of variance-stabilised counts that are scaled to n. Built-in functions only."""

    def stable(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
        return F.transform(a, lambda v: (F.sqrt(v * n / total) + 0.8 * F.sqrt(v * n / total + 1)) / 1.8)

    gap = F.zip_with(stable(x), stable(y), lambda a, b: F.pow(F.abs(a - b), F.lit(p)))
    return F.pow(F.aggregate(gap, F.lit(0.0), lambda t, v: t + v), F.lit(1 / p))


def _multinomial(p: np.ndarray, q: np.ndarray, some: bool = False) -> np.ndarray:
    """1 - 1 / (1 + evidence ratio) of one against two multinomials under flat priors; with some, over the components that either row has."""
    n = ((p > 0) | (q > 0)).sum(1) if some else np.full(len(p), p.shape[1])
    s, t = p.sum(1), q.sum(1)
    x = _lgamma(np.maximum(n, 1)) + _lgamma(s + t + n) - _lgamma(np.maximum(s + n, 1)) - _lgamma(np.maximum(t + n, 1))
    x += (_lgamma(p + 1) + _lgamma(q + 1) - _lgamma(p + q + 1)).sum(1)
    return 1 - 1 / (1 + np.exp(np.minimum(x, 700)))


def multinomial_distance(x: Column | str, y: Column | str) -> Column:
    return _pairs(_multinomial)(x, y)


def multinomial_subspace_distance(x: Column | str, y: Column | str) -> Column:
    """The same over the components that either vector has."""
    return _pairs(lambda p, q: _multinomial(p, q, some=True))(x, y)


def poisson_proximity(a: float, b: float):
    """UDF of two count vectors: the log evidence that one gamma prior of shape a and rate b gave rates common to both."""

    def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, s, t = x.shape[1], x.sum(1), y.sum(1)
        c = t / s
        joint = _lgamma(a + x + y).sum(1) + n * math.lgamma(a) - n * a * np.log(b + b * c + 1) + s * np.log(c) + (s + t) * np.log(b / (b + b * c + 1))
        apart = _lgamma(a + x).sum(1) + _lgamma(a + y).sum(1) - n * a * np.log((b + 1) * (b * c + 1)) + s * np.log(b * c / (b * c + 1)) + t * math.log(b / (b + 1))
        return joint - apart

    return _pairs(f)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function for a >= 1, x >= 0: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - _lgamma(a)) if a.size else out
    low = (x > 0) & (x < a + 1)
    if low.any():
        term = 1 / a[low]
        total, k = term.copy(), a[low].copy()
        for _ in range(2000):
            k += 1
            term = term * x[low] / k
            total += term
            if (term < total * 1e-15).all():
                break
        out[low] = 1 - total * front[low]
    high = x >= a + 1
    if high.any():
        b = x[high] + 1 - a[high]
        c, d = np.full(b.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - a[high])
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h *= d * c
            if (np.abs(d * c - 1) < 1e-14).all():
                break
        out[high] = h * front[high]
    return np.clip(out, 0.0, 1.0)


def expressed_above(groups: DataFrame, sizes: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(group_id, gene_id, probability) that a group expresses a gene above a threshold, under a gamma posterior.

    groups(group_id, gene_id, mean, count); sizes(group_id, size): the number of
    median-sized cells of a group. The posterior has the group's total plus 1 as
    its shape and size as its rate.
    """

    @pandas_udf("double")
    def tail(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(upper_gamma(x.to_numpy(), threshold * n.to_numpy()))

    d = groups.join(F.broadcast(sizes), "group_id")
    return d.select("group_id", "gene_id", tail(F.col("mean") * F.col("count") + 1.0, F.col("size")).alias("probability"))


def uniform_scaling(matrix: DataFrame, n_cells: int, rounds: int = 40, rate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Scalings (cell_id, u) and (gene_id, v) in (0, 1] so that mean(n u v) of a gene nears -ln(1 - share of cells with it).

    Gradient steps on the squared error; a step is two sums over packed blocks of the non-zeros (see grid).
    u has mean 1 in the end.
    """
    whole = Grid(matrix)
    share = F.col("k") / F.lit(float(n_cells))
    cells = whole.start("cell_id", [F.lit(0.5)])
    # what is wanted, v, v before, and the logarithm of the ratio
    genes = whole.start("gene_id", [-F.ln(F.greatest(F.lit(1e-9), 1 - share)), F.lit(0.5), F.lit(0.5), F.lit(0.0)])

    def ratios(got: np.ndarray, old: np.ndarray) -> np.ndarray:
        want, v = old[:, 0], old[:, 1]
        ratio = np.clip(want / np.maximum(got[:, 0] * v / n_cells, 1e-9), 0.25, 4.0)
        return np.stack([want, np.minimum(1.0, v * ratio**rate), v, np.log(ratio)], 1)

    def scaled(got: np.ndarray, old: np.ndarray) -> np.ndarray:
        return np.minimum(1.0, old * np.exp(rate / 2 * got[:, :1] / got[:, 1:]))

    for _ in range(rounds):
        genes = whole.step("gene_id", cells, genes, (1, 4), lambda i, j, n, a, b: [n * a[i, 0]], ratios)
        cells = whole.step("cell_id", cells, genes, (1, 4), lambda i, j, n, a, b: [n * b[j, 2] * b[j, 3], n * b[j, 2]], scaled)
    u, v = whole.rows("cell_id", cells, 1).select("cell_id", F.col("v")[0].alias("u")), whole.rows("gene_id", genes, 4).select("gene_id", F.col("v")[1].alias("v"))
    mean = F.broadcast(u.agg(F.avg("u").alias("m")))
    return u.crossJoin(mean).select("cell_id", (F.col("u") / F.col("m")).alias("u")), v.crossJoin(mean).select("gene_id", (F.col("v") * F.col("m")).alias("v"))
