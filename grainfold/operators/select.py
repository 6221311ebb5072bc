"""Feature selection: top genes by a score. Ties go to the smaller gene_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import div0


def top_genes(scores: DataFrame, n_genes: int, score: str = "variance") -> DataFrame:
    """(gene_id, rank): the first n by descending score; a sort with limit, no full sort."""
    best = scores.orderBy(F.desc(score), "gene_id").limit(n_genes)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "gene_id"))).select("gene_id", "rank")


def by_residuals(variance: DataFrame, summary: DataFrame, n_genes: int, masked: DataFrame | None = None) -> DataFrame:
    """Top genes by residual variance among the valid ones that are not masked. masked: (gene_id)."""
    ok = variance.join(summary.where("valid").select("gene_id"), "gene_id", "left_semi")
    if masked is not None:
        ok = ok.join(masked.select("gene_id"), "gene_id", "left_anti")
    return top_genes(ok, n_genes)


def by_deviance(deviance: DataFrame, summary: DataFrame, n_genes: int) -> DataFrame:
    return top_genes(deviance.join(summary.where("valid").select("gene_id"), "gene_id", "left_semi"), n_genes, "deviance")


def by_dispersion(summary: DataFrame, n_genes: int) -> DataFrame:
    """Top valid genes above the trend of log2 CV on log2 mean, a least-squares parabola.

    The trend is the closed-form fit from sums, so the fit is one aggregate.
    """
    d = summary.where("valid and mean > 0 and sd > 0").select("gene_id", F.log2("mean").alias("x"), F.log2(F.col("sd") / F.col("mean")).alias("y"))
    return top_genes(_above_parabola(d), n_genes, "score")


def _above_parabola(d: DataFrame) -> DataFrame:
    """d(gene_id, x, y) with score = y - parabola(x); x is centred first for a stable fit."""
    centre = F.broadcast(d.agg(F.avg("x").alias("c")))
    d = d.crossJoin(centre).withColumn("z", F.col("x") - F.col("c")).drop("c")
    sums = d.agg(*[F.sum(F.pow("z", F.lit(float(k)))).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow("z", F.lit(float(k))) * F.col("y")).alias(f"t{k}") for k in range(3)])
    s, t = [F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)]

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(s[0], s[1], s[2], s[1], s[2], s[3], s[2], s[3], s[4])
    fit = sums.select(
        div0(det(t[0], s[1], s[2], t[1], s[2], s[3], t[2], s[3], s[4]), whole).alias("b0"),
        div0(det(s[0], t[0], s[2], s[1], t[1], s[3], s[2], t[2], s[4]), whole).alias("b1"),
        div0(det(s[0], s[1], t[0], s[1], s[2], t[1], s[2], s[3], t[2]), whole).alias("b2"),
    )
    return d.crossJoin(F.broadcast(fit)).select("gene_id", "x", "y", (F.col("y") - F.col("b0") - F.col("b1") * F.col("z") - F.col("b2") * F.col("z") * F.col("z")).alias("score"))


def by_standardised_variance(matrix: DataFrame, summary: DataFrame, n_cells: int | Column, n_genes: int) -> DataFrame:
    """Top genes by the variance of counts standardised with the trend of log10 variance on log10 mean and clipped at sqrt(n)."""
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    d = summary.where("mean > 0 and sd > 0").select("gene_id", F.log10("mean").alias("x"), F.log10(F.col("sd") * F.col("sd")).alias("y"), "mean")
    trend = _above_parabola(d.select("gene_id", "x", "y")).select("gene_id", F.sqrt(F.pow(F.lit(10.0), F.col("y") - F.col("score"))).alias("expected"))
    e = matrix.join(trend.join(d.select("gene_id", "mean"), "gene_id"), "gene_id")
    bound = F.sqrt(n.cast("double"))
    # sums of whole numbers below the bound are exact, so genes of the same counts tie whatever the order of their rows
    clipped = (F.col("n") - F.col("mean")) / F.col("expected") > bound
    low = F.when(~clipped, F.col("n"))
    per = e.groupBy("gene_id").agg(F.coalesce(F.sum(low), F.lit(0)).alias("t"), F.coalesce(F.sum(low * low), F.lit(0)).alias("t2"), F.count_if(clipped).alias("c"), F.first("mean").alias("m"), F.first("expected").alias("e"))
    rest = n - F.col("c")  # zeros too
    s = (F.col("t") - rest * F.col("m")) / F.col("e") + F.col("c") * bound
    s2 = (F.col("t2") - 2 * F.col("m") * F.col("t") + rest * F.col("m") * F.col("m")) / (F.col("e") * F.col("e")) + F.col("c") * bound * bound
    return top_genes(per.select("gene_id", ((s2 - s * s / n) / (n - 1)).alias("score")), n_genes, "score")


def batch_stable(matrix: DataFrame, batches: DataFrame, genes: DataFrame, max_ratio: float = 4.0) -> DataFrame:
    """(gene_id, low, high, stable): the least and greatest share of cells with the gene over the batches; stable if their ratio is within max_ratio."""
    size = batches.groupBy("batch").agg(F.count("*").alias("size"))
    seen = matrix.where("n > 0").join(batches, "cell_id").groupBy("batch", "gene_id").agg(F.count("*").alias("k"))
    share = seen.join(F.broadcast(size), "batch").select("gene_id", (F.col("k") / F.col("size")).alias("share"))
    per = share.groupBy("gene_id").agg(F.min("share").alias("low"), F.max("share").alias("high"), F.count("*").alias("in_batches"))
    d = genes.select("gene_id").join(per, "gene_id", "left").crossJoin(F.broadcast(size.agg(F.count("*").alias("n_batches"))))
    low = F.when(F.col("in_batches") == F.col("n_batches"), F.col("low")).otherwise(0.0)
    d = d.select("gene_id", F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))
    ratio = div0(F.col("high"), F.col("low"))
    return d.withColumn("stable", ~((ratio > max_ratio) | (ratio < 1 / max_ratio)))


def by_multilevel_enrichment(enriched: list[DataFrame], n_per_group: list[int]) -> list[tuple]:
    """Greedy choice over levels of grouping: in each group of each level the next n genes that no earlier group took.

    enriched: one (group_id, gene_id, enrichment) table a level. Only the first
    candidates of each group, as many as can be taken in all, reach the driver.
    """
    taken: list[tuple] = []
    used: set = set()
    for level, (table, n) in enumerate(zip(enriched, n_per_group, strict=True)):
        groups = table.select("group_id").distinct().count()
        need = n + len(used) + n * groups
        w = Window.partitionBy("group_id").orderBy(F.desc("enrichment"), "gene_id")
        rows = table.withColumn("r", F.row_number().over(w)).where(F.col("r") <= need).orderBy("group_id", "r").collect()
        count: dict = {}
        for r in rows:
            if count.get(r.group_id, 0) < n and r.gene_id not in used:
                used.add(r.gene_id)
                count[r.group_id] = count.get(r.group_id, 0) + 1
                taken.append((level, r.group_id, r.gene_id))
    return taken


def laplacian_score(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Laplacian score of each gene over a graph: values(cell_id, gene_id, value) sparse, edges(src, dst, weight).

    1 - (x'Wx - (D'x)^2 / sum D) / (x'Dx - (D'x)^2 / sum D); a tiny denominator counts as 1e4.
    """
    degree = edges.groupBy(F.col("src").alias("cell_id")).agg(F.sum("weight").alias("d"))
    total = F.broadcast(degree.agg(F.sum("d").alias("volume")))
    v = values.join(degree, "cell_id")
    diag = v.groupBy("gene_id").agg(F.sum(F.col("d") * F.col("value")).alias("dx"), F.sum(F.col("d") * F.col("value") * F.col("value")).alias("xdx"))
    left = values.withColumnsRenamed({"cell_id": "src", "value": "a"})
    right = values.withColumnsRenamed({"cell_id": "dst", "value": "b"})
    across = left.join(edges, "src").join(right, ["dst", "gene_id"]).groupBy("gene_id").agg(F.sum(F.col("a") * F.col("b") * F.col("weight")).alias("xwx"))
    d = diag.join(across, "gene_id", "left").crossJoin(total)
    m = F.col("dx") * F.col("dx") / F.col("volume")
    below = F.col("xdx") - m
    below = F.when(F.abs(below) < 1e-12, F.lit(1e4)).otherwise(below)
    return d.select("gene_id", (1 - (F.coalesce("xwx", F.lit(0.0)) - m) / below).alias("score"))
