"""Grouped aggregation of vectors and of the sparse matrix, and group windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div0, var0

VECTOR = {"sum": F.sum, "count": lambda c: F.count(F.lit(1)), "first": F.first, "nnz": lambda c: F.count_if(F.col(c) != 0), "mean": F.avg, "variance": F.var_pop, "sd": F.stddev_pop}
MATRIX = ("sum", "nnz", "mean", "variance", "sd", "count")


def aggregate_vector(cells: DataFrame, by: str, requests: dict[str, tuple[str, str]]) -> DataFrame:
    """One groupBy for all requests {result: (column, using)}. `first` takes the value of the least cell_id."""
    out = []
    for name, (column, using) in requests.items():
        if using not in VECTOR:
            raise ValueError(f"cannot aggregate by {using}; use one of {', '.join(VECTOR)}")
        out.append((F.min_by(column, "cell_id") if using == "first" else VECTOR[using](column)).alias(name))
    return cells.groupBy(by).agg(*out)


def aggregate_matrix(matrix: DataFrame, groups: DataFrame, genes: DataFrame, using: list[str]) -> DataFrame:
    """Group x gene results, dense: groups(cell_id, group_id); zeros of the matrix count.

    Cells join their group, counts are summed before the result is densified.
    Of the two sides of the grid the sizes, one row a group, are sent to all tasks.
    """
    for u in using:
        if u not in MATRIX:
            raise ValueError(f"cannot aggregate by {u}; use one of {', '.join(MATRIX)}")
    size = groups.groupBy("group_id").agg(F.count("*").alias("n_cells"))
    per = matrix.join(groups, "cell_id").groupBy("group_id", "gene_id").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("s2"), F.count_if(F.col("n") != 0).alias("k"))
    d = genes.select("gene_id").crossJoin(F.broadcast(size)).join(per, ["group_id", "gene_id"], "left")
    s, s2, k, n = (F.coalesce(F.col(c), F.lit(0)) for c in ("s", "s2", "k", "n_cells"))
    made = {"sum": s, "nnz": k, "mean": div0(s, n), "variance": var0(s, s2, n), "sd": F.sqrt(var0(s, s2, n)), "count": n}
    return d.select("group_id", "gene_id", *[made[u].alias(u) for u in using])


def histogram(cells: DataFrame, row: Column, column: Column) -> DataFrame:
    """(row, col, n): a two-key count."""
    return cells.groupBy(row.alias("row"), column.alias("col")).agg(F.count("*").alias("n"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in an explicit order. The rows of a key are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_least")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"_least.{c}").alias(c) for c in rest])


def gaussian(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean vector and population covariance of two columns."""
    return df.agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_pop(x).alias("var_x"), F.covar_pop(x, y).alias("cov_xy"), F.var_pop(y).alias("var_y"))


def best_reference(profiles: DataFrame, references: DataFrame) -> DataFrame:
    """Per item the reference of greatest correlation: profiles(item, gene_id, x), references(ref, gene_id, y); both dense on shared genes."""
    r = profiles.join(references, "gene_id").groupBy("item", "ref").agg(F.corr("x", "y").alias("r"))
    return r.groupBy("item").agg(F.max(F.struct("r", (-F.col("ref")).alias("k"))).alias("m")).select("item", (-F.col("m.k")).alias("ref"), F.col("m.r").alias("r"))


def dense_labels(df: DataFrame, column: str, out: str) -> DataFrame:
    """Whole numbers from 0 for the distinct values of a column, in their order."""
    from .windows import positions

    return df.join(positions(df.select(column).distinct(), [column], out), column)


def one_hot(df: DataFrame, column: str, out: str = "one_hot") -> DataFrame:
    """df with an array of 0 and 1 for the distinct values of a column in their order; the last has no place, as the others determine it."""
    from .windows import positions

    codes = positions(df.select(column).distinct(), [column], "_code")
    last = F.broadcast(codes.agg(F.max("_code").alias("_last")))  # one row
    places = F.when(F.col("_last") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_last") - 1)).otherwise(F.array().cast("array<bigint>"))
    d = df.join(codes, column).crossJoin(last)
    return d.withColumn(out, F.transform(places, lambda i: (i == F.col("_code")).cast("int"))).drop("_code", "_last")


def require_aligned(left: DataFrame, right: DataFrame, key: str) -> None:
    """An error unless both have the same keys, each once; one aggregate over both, of which three numbers come back."""
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = sides.groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    found = each.agg(F.count_if(F.col("r") == 0).alias("left"), F.count_if(F.col("l") == 0).alias("right"), F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("twice")).first()
    if any(found):
        raise ValueError(f"rows do not align by {key}: {found.left} keys only on the left, {found.right} only on the right, {found.twice} repeated")
