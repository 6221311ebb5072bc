"""Genes of the same counts tie in the standardised variance."""

from pyspark.sql import functions as F

from grainfold.operators import qc, select


def test_equal_counts_tie(spark):
    counts = [1, 2, 50, 3, 7, 11, 45, 2, 9, 30]
    rows = [((i * (2 * g + 1) + g) % 97, g, n) for g in range(24) for i, n in enumerate(counts)]
    rows += [(i, g, i % (g - 20) + 1) for g in range(24, 30) for i in range(97)]
    m = spark.createDataFrame(rows, "cell_id long, gene_id long, n long")
    genes = spark.range(30).select(F.col("id").alias("gene_id"))
    for seed in range(3):
        mixed = m.repartition(3).orderBy(F.rand(seed))
        got = select.by_standardised_variance(mixed, qc.gene_summary(mixed, genes, 97), 97, 30).orderBy("rank").collect()
        same = [r.gene_id for r in got if r.gene_id < 24]
        assert len(got) == 30 and same == list(range(24))
