"""Residual normalisation over the non-zeros, with the zeros in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, div0, var0

THETA = 100.0


def _totals(matrix: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    cell = matrix.groupBy("cell_id").agg(F.sum("n").alias("cell_total"))
    gene = matrix.groupBy("gene_id").agg(F.sum("n").alias("gene_total"))
    return cell, gene, gene.agg(F.sum("gene_total").alias("all_total"))


def _residual(x: Column, mu: Column) -> Column:
    return div0(x - mu, F.sqrt(mu + mu * mu / THETA))


def pearson(matrix: DataFrame, n_cells: int | Column, *, low: str = "symmetric") -> DataFrame:
    """Residuals of the non-zeros under a negative binomial of theta 100, clipped at sqrt(n_cells).

    low: symmetric clips at the negative bound too, zero at 0. zero_residual is
    what a zero in that cell and gene would have, so dense results need no dense matrix.
    """
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    bound = F.sqrt(n.cast("double"))
    cell, gene, total = _totals(matrix)
    d = matrix.join(cell, "cell_id").join(gene, "gene_id").crossJoin(F.broadcast(total))
    mu = F.col("cell_total") * F.col("gene_total") / F.col("all_total").cast("double")
    bottom = -bound if low == "symmetric" else F.lit(0.0)
    return d.select("cell_id", "gene_id", clip(_residual(F.col("n"), mu), bottom, bound).alias("residual"), clip(_residual(F.lit(0.0), mu), bottom, bound).alias("zero_residual"))


def residual_variance(matrix: DataFrame, genes: DataFrame, n_cells: int | Column) -> DataFrame:
    """Variance over all cells of the residuals clipped at 0 from below: zeros then are 0 and need no row."""
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    r = pearson(matrix, n, low="zero").groupBy("gene_id").agg(F.sum("residual").alias("s"), F.sum(F.col("residual") * F.col("residual")).alias("s2"))
    return genes.join(r, "gene_id", "left").select("gene_id", var0(F.coalesce("s", F.lit(0.0)), F.coalesce("s2", F.lit(0.0)), n).alias("variance"))


def batch_residuals(matrix: DataFrame, batches: DataFrame, genes: DataFrame, n_cells: int | Column) -> DataFrame:
    """Residual variance where every batch has its own gene totals and is rescaled to a common mean.

    batches: (cell_id, batch). The expected count divides by the overall total;
    each gene and batch is rescaled by the mean over all genes and batches
    relative to its own.
    """
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    bound = F.sqrt(n.cast("double"))
    size = batches.groupBy("batch").agg(F.count("*").alias("size"))
    d = matrix.join(batches, "cell_id")
    cell = matrix.groupBy("cell_id").agg(F.sum("n").alias("cell_total"))
    gene = d.groupBy("batch", "gene_id").agg(F.sum("n").alias("gene_total"))
    total = gene.agg(F.sum("gene_total").alias("all_total"))
    d = d.join(cell, "cell_id").join(gene, ["batch", "gene_id"]).crossJoin(F.broadcast(total))
    mu = F.col("cell_total") * F.col("gene_total") / F.col("all_total").cast("double")
    r = clip(_residual(F.col("n"), mu), 0.0, bound)
    per = d.select("batch", "gene_id", r.alias("r")).groupBy("batch", "gene_id").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("s2"))
    per = per.join(F.broadcast(size), "batch").withColumn("mean", F.col("s") / F.col("size"))
    cells_of = F.broadcast(genes.agg(F.count("*").alias("n_genes")).crossJoin(size.agg(F.count("*").alias("n_batches"))))
    common = per.agg(F.sum("mean").alias("t")).crossJoin(cells_of).select((F.col("t") / (F.col("n_genes") * F.col("n_batches"))).alias("common"))
    scale = div0(F.col("common"), F.col("mean"))
    scaled = per.crossJoin(F.broadcast(common)).select("gene_id", (F.col("s") * scale).alias("s"), (F.col("s2") * scale * scale).alias("s2"))
    out = scaled.groupBy("gene_id").agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    return genes.join(out, "gene_id", "left").select("gene_id", var0(F.coalesce("s", F.lit(0.0)), F.coalesce("s2", F.lit(0.0)), n).alias("variance"))


def deviance(matrix: DataFrame, genes: DataFrame) -> DataFrame:
    """Binomial deviance of each gene: the zeros add -n ln(1 - p) each, so only their total is needed."""
    cell, gene, total = _totals(matrix)
    d = matrix.join(cell, "cell_id").join(gene, "gene_id").crossJoin(F.broadcast(total))
    y, n = F.col("n").cast("double"), F.col("cell_total").cast("double")
    p = F.col("gene_total") / F.col("all_total").cast("double")
    rest = n - y
    term = y * F.ln(y / (n * p)) + F.when(rest > 0, rest * F.ln(rest / (n * (1 - p)))).otherwise(0.0)
    per = d.groupBy("gene_id").agg(F.sum(term).alias("t"), F.sum(n).alias("seen"), F.first("gene_total").alias("g"), F.first("all_total").alias("a"))
    q = 1 - F.col("g") / F.col("a").cast("double")
    dev = 2 * (F.col("t") - F.when(q > 0, F.ln(q) * (F.col("a") - F.col("seen"))).otherwise(0.0))
    return genes.join(per, "gene_id", "left").select("gene_id", F.coalesce(dev, F.lit(0.0)).alias("deviance"))


def log2_normalised(matrix: DataFrame, cells: DataFrame, level: float = 0.0) -> DataFrame:
    """log2(count / total * level + 1) of the non-zeros; level 0 takes the median total of all cells. Zeros are 0."""
    cell = matrix.groupBy("cell_id").agg(F.sum("n").alias("cell_total"))
    every = cells.select("cell_id").join(cell, "cell_id", "left").select(F.coalesce("cell_total", F.lit(0)).alias("t"))
    lv = every.agg(F.median("t").alias("level")) if level == 0 else matrix.sparkSession.range(1).select(F.lit(float(level)).alias("level"))
    d = matrix.join(cell, "cell_id").crossJoin(F.broadcast(lv))
    return d.select("cell_id", "gene_id", F.log2(div0(F.col("n"), F.col("cell_total")) * F.col("level") + 1).alias("value"))


def gene_means(values: DataFrame, genes: DataFrame, n_cells: int | Column, column: str = "value") -> DataFrame:
    """Mean of a sparse value per gene over all cells: what centring subtracts."""
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    per = values.groupBy("gene_id").agg(F.sum(column).alias("s"))
    return genes.join(per, "gene_id", "left").select("gene_id", div0(F.coalesce("s", F.lit(0.0)), n).alias("mean"))
