"""Ordered operators: windowed means and medians along a sequence, renumbering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def forward_mean(df: DataFrame, keys: list[str], order: str, value: str, n: int, out: str = "smoothed") -> DataFrame:
    """Mean of the n values from each position on, within keys; at the end the window stays full and moves back.

    A sequence shorter than n takes its mean. Prefix sums make each window two
    look-ups: the window frame is a range of rows, so nothing is collected.
    """
    w = Window.partitionBy(*keys)
    o = w.orderBy(order)
    d = df.withColumn("_i", F.row_number().over(o)).withColumn("_n", F.count("*").over(w))
    full = F.avg(value).over(o.rowsBetween(0, n - 1))
    d = d.withColumn("_full", full)
    last = F.max(F.when(F.col("_i") == F.greatest(F.lit(1), F.col("_n") - n + 1), F.col("_full"))).over(w)
    return d.withColumn(out, F.when(F.col("_i") <= F.col("_n") - n + 1, F.col("_full")).otherwise(last)).drop("_i", "_n", "_full")


def centred(df: DataFrame, keys: list[str], order: str, value: str, n: int, how: str = "mean", out: str = "smoothed") -> DataFrame:
    """Mean or median of the values within n // 2 before (inclusive) and after (exclusive) each position; at the borders a full window of n moved inward."""
    half = n // 2
    w = Window.partitionBy(*keys)
    o = w.orderBy(order)
    agg = {"mean": F.avg, "median": F.median}[how]
    d = df.withColumn("_i", F.row_number().over(o)).withColumn("_n", F.count("*").over(w))
    d = d.withColumn("_a", F.collect_list(value).over(o.rowsBetween(-n, n)))
    first = F.greatest(F.lit(1), F.col("_i") - n)  # position of the first of the list
    start = F.col("_i") - half
    stop = F.col("_i") + half
    nn = F.least(F.lit(n), F.col("_n"))
    start, stop = (
        F.when(F.col("_i") - half < 1, F.lit(1)).when(F.col("_i") + half - 1 > F.col("_n"), F.col("_n") - nn + 1).otherwise(start),
        F.when(F.col("_i") - half < 1, nn + 1).when(F.col("_i") + half - 1 > F.col("_n"), F.col("_n") + 1).otherwise(stop),
    )
    part = F.slice("_a", (start - first + 1).cast("int"), (stop - start).cast("int"))
    if how == "mean":
        value_ = F.aggregate(part, F.lit(0.0), lambda t, x: t + x) / F.size(part)
    else:
        s = F.array_sort(part)
        k = F.size(s)
        value_ = (F.element_at(s, F.floor((k + 1) / 2).cast("int")) + F.element_at(s, F.floor(k / 2).cast("int") + 1)) / 2
    del agg
    return d.withColumn(out, value_).drop("_i", "_n", "_a")


def lowess(df: DataFrame, keys: list[str], order: str, value: str, bandwidth: float, out: str = "smoothed", robust: int = 3) -> DataFrame:
    """Local linear regression of value on order within keys, over the share min(0.5, bandwidth / n) of a sequence's n rows.

    Sequences (the genes of a chromosome in one group) are bounded by the genome.
    A sequence whose share is under two rows keeps its values.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(**{out: local_lines(pdf[order].to_numpy(float), pdf[value].to_numpy(float), min(0.5, bandwidth / len(pdf)), robust)})

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"
    return df.groupBy(*keys).applyInPandas(fit, shape)


def local_lines(x: np.ndarray, y: np.ndarray, share: float, robust: int = 3) -> np.ndarray:
    """The value at each x (ascending) of a line through its nearest points, by tricube weights; far residuals lose weight by the bisquare in each robust round."""
    n = len(x)
    k = int(share * n + 1e-10)
    if k < 2:
        return y.copy()
    first = np.zeros(n, np.int64)
    at = 0
    for i in range(n):
        while at + k < n and x[i] > (x[at] + x[at + k]) / 2:
            at += 1
        first[i] = at
    trust, out = np.ones(n), np.empty(n)
    rows = max(1, (1 << 18) // k)
    for turn in range(robust + 1):
        for a in range(0, n, rows):
            near = first[a : a + rows, None] + np.arange(k)
            here, xs = x[a : a + rows, None], x[near]
            d = np.abs(xs - here)
            h = d.max(1, keepdims=True)
            w = np.where(d <= 0.001 * h, 1.0, (1 - (d / np.maximum(h, 1e-300)) ** 3) ** 3) * (d <= 0.999 * h) * trust[near]
            w[(h == 0)[:, 0]] = trust[near[(h == 0)[:, 0]]]
            total = w.sum(1, keepdims=True)
            w = w / np.maximum(total, 1e-300)
            mid = (w * xs).sum(1, keepdims=True)
            spread = (w * (xs - mid) ** 2).sum(1, keepdims=True)
            tilt = np.where(spread > 1e-12, (here - mid) * (xs - mid) / np.maximum(spread, 1e-12), 0.0)
            out[a : a + rows] = np.where(total[:, 0] > 0, (w * (1 + tilt) * y[near]).sum(1), y[a : a + rows])
        off = np.abs(y - out)
        scale = 6 * np.median(off)
        if turn == robust or scale == 0:
            break
        trust = np.where(off >= 0.999 * scale, 0.0, (1 - (off / scale) ** 2) ** 2)
        trust[off <= 0.001 * scale] = 1.0
    return out


def positions(df: DataFrame, order: list, out: str, weight: str | None = None) -> DataFrame:
    """df with `out`: the number of rows (or the sum of their weights) before a row in this order.

    Rows are dealt into ranges of the order, which are written; a row's number is
    its place in its range after the sizes of earlier ranges. No task has more
    than a range, and only one row for each range meets in one task.
    """
    from ..plans.storage import persist

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1) if weight is None else F.col(weight)
    d = persist(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    size = d.groupBy("_range").agg(F.sum(one).alias("_size"))
    earlier = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    skip = F.broadcast(size.select("_range", F.coalesce(earlier, F.lit(0)).alias("_skip")))
    inside = F.sum(one).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return d.join(skip, "_range").withColumn(out, (F.col("_skip") + F.coalesce(inside, F.lit(0))).cast("bigint")).drop("_range", "_skip")


def renumber(df: DataFrame, source: str, label: str, out: str = "label") -> DataFrame:
    """Labels of several sources in one range: each source's labels become 0..k-1 in their order, after those of earlier sources."""
    return df.join(positions(df.select(source, label).distinct(), [source, label], out), [source, label])


def equal_bins(df: DataFrame, value: str, key: str, n_bins: int, out: str = "bin") -> DataFrame:
    """n_bins bins of equal size by ascending value; the remainder at the low end is left out."""
    n = df.count()
    size = max(1, n // n_bins)
    low = n - size * n_bins
    return positions(df, [value, key], "_r").withColumn("_r", F.col("_r") - low).where("_r >= 0").withColumn(out, F.floor(F.col("_r") / size)).drop("_r")


def share_of_column_max(counts: DataFrame) -> DataFrame:
    """(row, col, share): counts(row, col, n) divided by the row's sum and then by the column's maximum."""
    r = F.sum("n").over(Window.partitionBy("row"))
    d = counts.withColumn("_s", F.col("n") / r)
    return d.select("row", "col", (F.col("_s") / F.max("_s").over(Window.partitionBy("col"))).alias("share"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
