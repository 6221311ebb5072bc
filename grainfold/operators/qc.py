"""Quality control: summaries of cells and genes, filters, droplet classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div0, mean0, strip_version, var0

#: Marker genes in the order in which they are looked for, and their species.
SPECIES = (
    ("ACTB", "Homo sapiens"),
    ("Tspy1", "Rattus norvegicus"),
    ("Actb", "Mus musculus"),
    ("actb1", "Danio rerio"),
    ("Act5C", "Drosophila melanogaster"),
    ("ACT1", "Saccharomyces cerevisiae"),
    ("act1", "Schizosaccharomyces pombe"),
    ("act-1", "Caenorhabditis elegans"),
    ("ACT12", "Arabidopsis thaliana"),
    ("AFTTAS", "Gallus gallus"),
)


def cell_summary(matrix: DataFrame, cells: DataFrame, genes: DataFrame, mito: str = "is_mt", cycle: str | None = "is_cc") -> DataFrame:
    """Per cell: genes seen, total, and the shares of mitochondrial, unspliced and cell-cycle counts.

    Cells without counts have zeros and null shares. The flags are columns of genes.
    """
    flags = genes.select("gene_id", F.col(mito).alias("_m"), (F.col(cycle) if cycle else F.lit(False)).alias("_c"))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("total_umis"))
    per = matrix.join(flags, "gene_id").groupBy("cell_id").agg(
        F.count_if(F.col("n") > 0).alias("n_genes"),
        F.sum("n").alias("total_umis"),
        F.sum(F.when(F.col("_m"), F.col("n")).otherwise(0)).alias("_mt"),
        F.sum("u").alias("_u"),
        F.sum(F.when(F.col("_c"), F.col("n")).otherwise(0)).alias("_cc"),
    )
    return cells.join(per, "cell_id", "left").select(
        "cell_id",
        F.coalesce("n_genes", F.lit(0)).alias("n_genes"),
        F.coalesce("total_umis", F.lit(0)).alias("total_umis"),
        share("_mt").alias("mito_fraction"),
        share("_u").alias("unspliced_fraction"),
        share("_cc").alias("cell_cycle_fraction"),
    )


def gene_summary(matrix: DataFrame, genes: DataFrame, n_cells: int | Column, valid_fraction: float = 0.001) -> DataFrame:
    """Per gene over all cells, zeros included: mean, standard deviation, non-zeros, total, validity."""
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    per = matrix.groupBy("gene_id").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count_if(F.col("n") > 0).alias("nnz"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return genes.join(per, "gene_id", "left").select(
        "gene_id",
        mean0(zero("total"), n).alias("mean"),
        F.sqrt(var0(zero("total"), zero("squares"), n)).alias("sd"),
        zero("nnz").alias("nonzeros"),
        zero("total").alias("total_umis"),
        (zero("nnz") > n * valid_fraction).alias("valid"),
    )


def quality_control(cells: DataFrame, *, doublet_threshold: float | str = "auto", min_umis: int = 0, max_mito: float = 1.0, min_unspliced: float = 0.0) -> DataFrame:
    """cells with `valid`: not a doublet, enough counts, little mitochondrial and enough unspliced RNA. Unknown shares fail."""
    single = ~F.col("doublet_flag") if doublet_threshold == "auto" else F.col("doublet_score") < doublet_threshold
    ok = single & (F.col("total_umis") >= min_umis) & (F.col("mito_fraction") < max_mito) & (F.col("unspliced_fraction") >= min_unspliced)
    return cells.withColumn("valid", F.coalesce(ok, F.lit(False)))


def sample_passes(cells: DataFrame, min_good: float, by: str | None = None) -> DataFrame:
    """Per sample (or for all cells): the share of valid cells and whether it reaches min_good."""
    good = F.avg(F.col("valid").cast("double"))
    return cells.groupBy(*([by] if by else [])).agg(good.alias("good_fraction"), (good >= min_good).alias("passed"))


def detect_species(genes: DataFrame, symbols: str = "gene") -> DataFrame:
    """One row: the species of the first marker gene that occurs, null if none does."""
    spark = genes.sparkSession
    probes = spark.createDataFrame([(i, g, s) for i, (g, s) in enumerate(SPECIES)], "rank int, probe string, species string")
    return genes.join(F.broadcast(probes), genes[symbols] == probes["probe"]).agg(F.min_by("species", "rank").alias("species"))


def gene_mask(genes: DataFrame, sets: DataFrame, categories: list[str]) -> DataFrame:
    """genes with `masked`: the symbol, or the accession without its version, is in a set of the categories.

    sets: (category, gene).
    """
    listed = sets.where(F.col("category").isin(categories)).select(F.col("gene").alias("_listed")).distinct()
    by_symbol = genes.join(listed, genes["gene"] == listed["_listed"], "left_semi").select("gene_id")
    by_accession = genes.join(listed, strip_version(genes["accession"]) == listed["_listed"], "left_semi").select("gene_id")
    hit = by_symbol.union(by_accession).distinct().withColumn("_hit", F.lit(True))
    return genes.join(hit, "gene_id", "left").withColumn("masked", F.coalesce("_hit", F.lit(False))).drop("_hit")


def housekeeping(gene_stats: DataFrame, n_cells: int | Column, max_variance: float, min_umis: float) -> DataFrame:
    """Genes of low residual variance and of enough counts a cell."""
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    return gene_stats.where((F.col("variance") < max_variance) & (div0(F.col("total_umis"), n) > min_umis))


def classify_droplets(cells: DataFrame, *, min_umis: int = 1500, min_unspliced: float = 0.1, m: float = 200, k: float = 1000, min_pdf: float = 0.1, max_doublet: float = 0.4, max_mito: float = 0.25) -> DataFrame:
    """cells with droplet_class 0 cell, 1 large, 2 doublet, 3 cytoplasmic debris, 4 cell debris, 5 nuclear, 6 mitochondrial, and `valid`.

    A two-dimensional normal is fitted to (2u, t), t = log10 of the total, of the
    selected droplets; those of enough density pass, and the percentiles of
    their u divide the rest. Later rules win over earlier ones.
    """
    t, u = F.log10(F.greatest(F.col("total_umis").cast("double"), F.lit(1.0))), F.coalesce("unspliced_fraction", F.lit(0.0))
    d = cells.withColumn("_t", t).withColumn("_u", u).withColumn("_x", 2 * u)
    d = d.withColumn("_sel", (F.col("_t") > F.log10(F.lit(float(m))) + F.col("_u") * F.log10(F.lit(float(k)))) & (F.col("_u") > min_unspliced) & (F.col("_t") > F.log10(F.lit(float(min_umis)))))
    fit = d.where("_sel").agg(F.avg("_x").alias("mx"), F.avg("_t").alias("my"), F.var_pop("_x").alias("vx"), F.var_pop("_t").alias("vy"), F.covar_pop("_x", "_t").alias("vxy"))
    d = d.crossJoin(F.broadcast(fit))
    det = F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")
    dx, dy = F.col("_x") - F.col("mx"), F.col("_t") - F.col("my")
    q = F.try_divide(F.col("vy") * dx * dx - 2 * F.col("vxy") * dx * dy + F.col("vx") * dy * dy, det)
    d = d.withColumn("_pass", F.coalesce(F.exp(-q / 2) / (F.lit(2 * 3.141592653589793) * F.sqrt(det)) > min_pdf, F.lit(False)))
    cut = d.where("_pass").agg(F.percentile("_u", F.lit(0.01)).alias("p1"), F.percentile("_u", F.lit(0.99)).alias("p99"))
    mid = d.agg(F.median("total_umis").alias("mid"))
    d = d.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(mid))
    rules = (
        F.when(F.col("doublet_score") > max_doublet, 2)
        .when(F.col("_sel") & ~F.col("_pass") & (F.col("total_umis") > F.col("mid")), 1)
        .when(F.col("mito_fraction") > max_mito, 6)
        .when(~F.col("_pass") & (F.col("_u") < F.col("p1")), 3)
        .when(~F.col("_pass") & (F.col("_u") < F.col("p99")), 4)
        .when(~F.col("_pass"), 5)
        .otherwise(0)
    )
    return d.withColumn("droplet_class", rules).withColumn("valid", F.col("droplet_class") == 0).select(*cells.columns, "droplet_class", "valid")
