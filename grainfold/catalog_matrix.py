"""Queries on the sparse matrix: quality control, residuals, selection, aggregation, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregate, enrich, qc, residuals, select, windows
from .plans.storage import persist
from .registry import register
from .sources import orders

QUERIES: dict = {}


def _load(spark: SparkSession, sf_dir: str):
    return orders.matrix(spark, sf_dir), orders.cells(spark, sf_dir), orders.genes(spark, sf_dir)


def _load_once(spark: SparkSession, sf_dir: str):
    """The same with the matrix written once, for queries that read it several times."""
    return persist(orders.matrix(spark, sf_dir)), orders.cells(spark, sf_dir), orders.genes(spark, sf_dir)


def _no_broadcast(genes: DataFrame) -> DataFrame:
    """genes with joins by sorting: Parquet packs them so well that millions are taken for small and would pass through the driver."""
    return genes.hint("merge")


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


#: SQL of the summaries that several queries build on.
CELL_STATS = """cell_stats AS (SELECT c.cell_id, COUNT(n) FILTER (n > 0) AS n_genes, COALESCE(SUM(n), 0)::BIGINT AS total_umis,
  SUM(CASE WHEN is_mt THEN n ELSE 0 END)::DOUBLE / SUM(n) AS mito_fraction, SUM(u)::DOUBLE / SUM(n) AS unspliced_fraction,
  SUM(CASE WHEN is_cc THEN n ELSE 0 END)::DOUBLE / SUM(n) AS cell_cycle_fraction
  FROM cells c LEFT JOIN matrix USING (cell_id) LEFT JOIN genes USING (gene_id) GROUP BY 1)"""
GENE_STATS = """nc AS (SELECT COUNT(*)::DOUBLE AS nc FROM cells),
gene_stats AS (SELECT g.gene_id, COALESCE(SUM(n), 0) / MAX(nc) AS mean,
  SQRT(GREATEST(0, COALESCE(SUM(n * n), 0) / MAX(nc) - POW(COALESCE(SUM(n), 0) / MAX(nc), 2))) AS sd,
  COUNT(n) FILTER (n > 0) AS nonzeros, COALESCE(SUM(n), 0)::BIGINT AS total_umis, COUNT(n) FILTER (n > 0) > 0.001 * MAX(nc) AS valid
  FROM genes g LEFT JOIN matrix USING (gene_id) CROSS JOIN nc GROUP BY 1)"""
EXPECTED = """ct AS (SELECT cell_id, SUM(n) AS ct FROM matrix GROUP BY 1), gt AS (SELECT gene_id, SUM(n) AS gt FROM matrix GROUP BY 1),
al AS (SELECT SUM(n) AS al FROM matrix),
ex AS (SELECT m.*, ct, gt, al, ct::DOUBLE * gt / al AS mu FROM matrix m JOIN ct USING (cell_id) JOIN gt USING (gene_id) CROSS JOIN al)"""
VARIANCE = f"""{EXPECTED},
rv0 AS (SELECT gene_id, LEAST(GREATEST((n - mu) / SQRT(mu + mu * mu / 100), 0), SQRT((SELECT nc FROM nc))) AS r FROM ex),
rv AS (SELECT g.gene_id, GREATEST(0, COALESCE(SUM(r * r), 0) / MAX(nc) - POW(COALESCE(SUM(r), 0) / MAX(nc), 2)) AS variance
  FROM genes g LEFT JOIN rv0 USING (gene_id) CROSS JOIN nc GROUP BY 1)"""
GROUPS = """sizes AS (SELECT cluster_id AS group_id, COUNT(*) AS count FROM cells GROUP BY 1),
per AS (SELECT cluster_id AS group_id, gene_id, SUM(n) AS s, SUM(n * n) AS s2, COUNT(*) FILTER (n <> 0) AS nnz FROM matrix JOIN cells USING (cell_id) GROUP BY 1, 2),
grid AS (SELECT group_id, gene_id, count, COALESCE(s, 0)::BIGINT AS s, COALESCE(nnz, 0)::BIGINT AS nnz, COALESCE(s, 0)::DOUBLE / count AS mean,
  GREATEST(0, COALESCE(s2, 0)::DOUBLE / count - POW(COALESCE(s, 0)::DOUBLE / count, 2)) AS variance
  FROM sizes CROSS JOIN genes LEFT JOIN per USING (group_id, gene_id))"""
ENRICHED = f"""{GROUPS},
w AS (SELECT *, SUM(count) OVER g AS tn, SUM(count * mean) OVER g AS tm, SUM(nnz) OVER g AS tk FROM grid WINDOW g AS (PARTITION BY gene_id)),
enriched AS (SELECT group_id, gene_id, count, nnz, mean, (nnz::DOUBLE / count + 0.1) / ((tk - nnz)::DOUBLE / (tn - count) + 0.1)
  * (mean + 0.01) / ((tm - count * mean) / (tn - count) + 0.01) AS enrichment FROM w)"""
#: P(share >= 0.2) by a finite sum over the whole second parameter.
TRINARIES = f"""{GROUPS},
keys AS (SELECT DISTINCT nnz AS k, count AS n FROM grid),
terms AS (SELECT k, n, j, EXP((1.5 + k) * LN(0.2) + j * LN(0.8::DOUBLE) + LGAMMA(1.5 + k + j) - LGAMMA(1.5 + k) - LGAMMA(j + 1.0::DOUBLE)) AS t
  FROM (SELECT k, n, UNNEST(RANGE(0, 2 + n - k)) AS j FROM keys)),
prob AS (SELECT k, n, GREATEST(0, 1 - LEAST(1, SUM(t))) AS p FROM terms GROUP BY 1, 2),
trinaries AS (SELECT group_id, gene_id, p AS probability FROM grid JOIN prob ON nnz = k AND count = n)"""
TERM_VALUES = [("A1", "+G1 +G2"), ("A2", "+G3 -G4"), ("A3", "-G5"), ("A4", "+G6 +G7 -G8 +GX")]
TERM_SQL = "terms_(term, definition) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TERM_VALUES) + ")"


@register(QUERIES, f"+ {CELL_STATS} SELECT cell_id, n_genes, total_umis, ROUND(mito_fraction, 6) AS mito_fraction, ROUND(unspliced_fraction, 6) AS unspliced_fraction, ROUND(cell_cycle_fraction, 6) AS cell_cycle_fraction FROM cell_stats")
def cell_summary(spark, sf_dir):
    out = qc.cell_summary(*_load(spark, sf_dir))
    return out.select("cell_id", "n_genes", "total_umis", _r("mito_fraction"), _r("unspliced_fraction"), _r("cell_cycle_fraction"))


def _gene_stats(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    return qc.gene_summary(m, g, c.count())


@register(QUERIES, f"+ {GENE_STATS} SELECT gene_id, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, nonzeros, total_umis, valid FROM gene_stats")
def gene_summary(spark, sf_dir):
    return _gene_stats(spark, sf_dir).select("gene_id", _r("mean"), _r("sd"), "nonzeros", "total_umis", "valid")


@register(QUERIES, "SELECT SUM(n)::BIGINT AS overall_total_umis FROM matrix")
def overall_total(spark, sf_dir):
    return orders.matrix(spark, sf_dir).agg(F.sum("n").alias("overall_total_umis"))


def _qc_cells(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    return qc.cell_summary(m, c, g).join(c, "cell_id").withColumn("doublet_flag", F.col("doublet_score") > 0.9)


@register(QUERIES, f"+ {CELL_STATS} SELECT cell_id, COALESCE(NOT (doublet_score > 0.9) AND total_umis >= 500 AND mito_fraction < 0.1 AND unspliced_fraction >= 0.1, FALSE) AS valid FROM cell_stats JOIN cells USING (cell_id)")
def quality_control(spark, sf_dir):
    return qc.quality_control(_qc_cells(spark, sf_dir), min_umis=500, max_mito=0.1, min_unspliced=0.1).select("cell_id", "valid")


@register(QUERIES, f"+ {CELL_STATS}, v AS (SELECT sample_id, COALESCE(doublet_score < 0.8 AND total_umis >= 500 AND mito_fraction < 0.1 AND unspliced_fraction >= 0.1, FALSE)::INT::DOUBLE AS ok FROM cell_stats JOIN cells USING (cell_id)) SELECT sample_id, ROUND(AVG(ok), 6) AS good_fraction, AVG(ok) >= 0.4 AS passed FROM v GROUP BY 1")
def sample_quality(spark, sf_dir):
    checked = qc.quality_control(_qc_cells(spark, sf_dir), doublet_threshold=0.8, min_umis=500, max_mito=0.1, min_unspliced=0.1)
    return qc.sample_passes(checked, 0.4, "sample_id").select("sample_id", _r("good_fraction"), "passed")


SPECIES_SQL = ", ".join(f"({i}, '{g}', '{s}')" for i, (g, s) in enumerate(qc.SPECIES))


@register(QUERIES, f"+ probes(rank, probe, species) AS (VALUES {SPECIES_SQL}), named AS (SELECT CASE gene_id WHEN 3 THEN 'Actb' WHEN 8 THEN 'act-1' WHEN 9 THEN 'Tspy1' ELSE gene END AS gene FROM genes) SELECT ARG_MIN(species, rank) AS species FROM named JOIN probes ON gene = probe")
def detect_species(spark, sf_dir):
    g = orders.genes(spark, sf_dir)
    named = F.when(F.col("gene_id") == 3, "Actb").when(F.col("gene_id") == 8, "act-1").when(F.col("gene_id") == 9, "Tspy1").otherwise(F.col("gene"))
    return qc.detect_species(g.withColumn("gene", named))


def _gene_sets(spark, sf_dir):
    g = orders.genes(spark, sf_dir)
    by_symbol = g.where("size between 1 and 3").select(F.lit("g1").alias("category"), "gene")
    by_accession = g.where("size = 50").select(F.lit("ieg"), F.substring_index("accession", ".", 1))
    return by_symbol.union(by_accession).union(g.where("type = 'PROMO'").select(F.lit("tf"), "gene"))


@register(QUERIES, "SELECT gene_id, (size BETWEEN 1 AND 3 OR size = 50) AS masked FROM genes")
def gene_mask(spark, sf_dir):
    return qc.gene_mask(orders.genes(spark, sf_dir), _gene_sets(spark, sf_dir), ["g1", "ieg"]).select("gene_id", "masked")


DROPLETS = f"""+ {CELL_STATS}, b AS (SELECT s.*, doublet_score, LOG10(GREATEST(total_umis, 1)::DOUBLE) AS t, COALESCE(unspliced_fraction, 0) AS u FROM cell_stats s JOIN cells USING (cell_id)),
s AS (SELECT *, 2 * u AS x, t > LOG10(200::DOUBLE) + u * LOG10(1000::DOUBLE) AND u > 0.1 AND t > LOG10(500::DOUBLE) AS sel FROM b),
f AS (SELECT AVG(x) AS mx, AVG(t) AS my, VAR_POP(x) AS vx, VAR_POP(t) AS vy, COVAR_POP(x, t) AS vxy FROM s WHERE sel),
p AS (SELECT s.*, EXP(-(vy * (x - mx) * (x - mx) - 2 * vxy * (x - mx) * (t - my) + vx * (t - my) * (t - my)) / (vx * vy - vxy * vxy) / 2) / (2 * PI() * SQRT(vx * vy - vxy * vxy)) > 0.1 AS pass FROM s CROSS JOIN f),
q AS (SELECT QUANTILE_CONT(u, 0.01) AS p1, QUANTILE_CONT(u, 0.99) AS p99 FROM p WHERE pass), mid AS (SELECT MEDIAN(total_umis) AS mid FROM p)
SELECT cell_id, CASE WHEN doublet_score > 0.9 THEN 2 WHEN sel AND NOT pass AND total_umis > mid THEN 1 WHEN mito_fraction > 0.25 THEN 6
 WHEN NOT pass AND u < p1 THEN 3 WHEN NOT pass AND u < p99 THEN 4 WHEN NOT pass THEN 5 ELSE 0 END AS droplet_class FROM p CROSS JOIN q CROSS JOIN mid"""


@register(QUERIES, DROPLETS)
def classify_droplets(spark, sf_dir):
    return qc.classify_droplets(_qc_cells(spark, sf_dir), min_umis=500, max_doublet=0.9).select("cell_id", "droplet_class")


@register(QUERIES, f"+ {GENE_STATS}, {EXPECTED}, r AS (SELECT cell_id, gene_id, (n - mu) / SQRT(mu + mu * mu / 100) AS r, -mu / SQRT(mu + mu * mu / 100) AS z, SQRT(nc) AS b FROM ex CROSS JOIN nc) SELECT cell_id, gene_id, ROUND(LEAST(GREATEST(r, -b), b), 6) AS residual, ROUND(LEAST(GREATEST(z, -b), b), 6) AS zero_residual FROM r")
def pearson_residuals(spark, sf_dir):
    m, c, _ = _load_once(spark, sf_dir)
    return residuals.pearson(m, c.count()).select("cell_id", "gene_id", _r("residual"), _r("zero_residual"))


def _variance(spark, sf_dir):
    m, c, g = _load_once(spark, sf_dir)
    return residuals.residual_variance(m, g, c.count())


@register(QUERIES, f"+ {GENE_STATS}, {VARIANCE} SELECT gene_id, ROUND(variance, 6) AS variance FROM rv")
def residual_variance(spark, sf_dir):
    return _variance(spark, sf_dir).select("gene_id", _r("variance"))


BATCHED = """+ nc AS (SELECT COUNT(*)::DOUBLE AS nc FROM cells), bs AS (SELECT chemistry AS batch, COUNT(*) AS size FROM cells GROUP BY 1),
mb AS (SELECT m.*, chemistry AS batch FROM matrix m JOIN cells USING (cell_id)), ct AS (SELECT cell_id, SUM(n) AS ct FROM matrix GROUP BY 1),
gb AS (SELECT batch, gene_id, SUM(n) AS gt FROM mb GROUP BY 1, 2), al AS (SELECT SUM(n) AS al FROM matrix),
r AS (SELECT batch, gene_id, LEAST(GREATEST((n - ct::DOUBLE * gt / al) / SQRT(ct::DOUBLE * gt / al + POW(ct::DOUBLE * gt / al, 2) / 100), 0), SQRT(nc)) AS r FROM mb JOIN ct USING (cell_id) JOIN gb USING (batch, gene_id) CROSS JOIN al CROSS JOIN nc),
pb AS (SELECT batch, gene_id, SUM(r) AS s, SUM(r * r) AS s2, SUM(r) / MAX(size) AS mean FROM r JOIN bs USING (batch) GROUP BY 1, 2),
cm AS (SELECT SUM(mean) / ((SELECT COUNT(*) FROM genes) * (SELECT COUNT(*) FROM bs)) AS cm FROM pb),
sc AS (SELECT gene_id, SUM(CASE WHEN mean = 0 THEN 0 ELSE s * cm / mean END) AS s, SUM(CASE WHEN mean = 0 THEN 0 ELSE s2 * cm / mean * cm / mean END) AS s2 FROM pb CROSS JOIN cm GROUP BY 1)
SELECT g.gene_id, ROUND(GREATEST(0, COALESCE(s2, 0) / nc - POW(COALESCE(s, 0) / nc, 2)), 6) AS variance FROM genes g LEFT JOIN sc USING (gene_id) CROSS JOIN nc"""


@register(QUERIES, BATCHED)
def batch_residual_variance(spark, sf_dir):
    m, c, g = _load_once(spark, sf_dir)
    return residuals.batch_residuals(m, c.select("cell_id", F.col("chemistry").alias("batch")), g, c.count()).select("gene_id", _r("variance"))


DEVIANCE = f"""{EXPECTED}, dv AS (SELECT gene_id, SUM(n * LN(n / (ct::DOUBLE * gt / al)) + CASE WHEN ct > n THEN (ct - n) * LN((ct - n) / (ct * (1 - gt::DOUBLE / al))) ELSE 0 END) AS t, SUM(ct) AS seen, MAX(gt) AS gt, MAX(al) AS al FROM ex GROUP BY 1)"""


@register(QUERIES, f"+ {DEVIANCE} SELECT g.gene_id, ROUND(COALESCE(2 * (t - LN(1 - gt::DOUBLE / al) * (al - seen)), 0), 4) AS deviance FROM genes g LEFT JOIN dv USING (gene_id)")
def deviance_statistics(spark, sf_dir):
    m, _, g = _load_once(spark, sf_dir)
    return residuals.deviance(m, g).select("gene_id", _r("deviance", 4))


LOG2 = """ct AS (SELECT cell_id, SUM(n) AS ct FROM matrix GROUP BY 1), lv AS (SELECT MEDIAN(COALESCE(ct, 0)) AS lv FROM cells LEFT JOIN ct USING (cell_id)),
l2 AS (SELECT cell_id, gene_id, LOG2(n::DOUBLE / ct * lv + 1) AS value FROM matrix JOIN ct USING (cell_id) CROSS JOIN lv)"""


@register(QUERIES, f"+ {LOG2} SELECT cell_id, gene_id, ROUND(value, 6) AS value FROM l2")
def log2_normalised(spark, sf_dir):
    m, c, _ = _load(spark, sf_dir)
    return residuals.log2_normalised(m, c).select("cell_id", "gene_id", _r("value"))


@register(QUERIES, f"+ {LOG2} SELECT g.gene_id, ROUND(COALESCE(SUM(value), 0) / (SELECT COUNT(*) FROM cells), 6) AS mean FROM genes g LEFT JOIN l2 USING (gene_id) GROUP BY 1")
def log2_gene_means(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    return residuals.gene_means(residuals.log2_normalised(m, c), g, c.count()).select("gene_id", _r("mean"))


@register(QUERIES, f"+ {GENE_STATS}, {VARIANCE} SELECT gene_id, ROW_NUMBER() OVER (ORDER BY variance DESC, gene_id)::INT AS rank FROM rv JOIN gene_stats USING (gene_id) JOIN genes USING (gene_id) WHERE valid AND NOT (size BETWEEN 1 AND 3 OR size = 50) QUALIFY rank <= 200")
def top_variable_genes(spark, sf_dir):
    m, c, g = _load_once(spark, sf_dir)
    n = c.count()
    masked = qc.gene_mask(g, _gene_sets(spark, sf_dir), ["g1", "ieg"]).where("masked")
    return select.by_residuals(residuals.residual_variance(m, g, n), qc.gene_summary(m, g, n), 200, masked)


@register(QUERIES, f"+ {GENE_STATS}, {DEVIANCE} SELECT gene_id, ROW_NUMBER() OVER (ORDER BY ROUND(2 * (t - LN(1 - gt::DOUBLE / al) * (al - seen)), 6) DESC, gene_id)::INT AS rank FROM dv JOIN gene_stats USING (gene_id) WHERE valid QUALIFY rank <= 200")
def top_deviant_genes(spark, sf_dir):
    m, c, g = _load_once(spark, sf_dir)
    return select.by_deviance(residuals.deviance(m, g).select("gene_id", _r("deviance")), qc.gene_summary(m, g, c.count()), 200)


#: A least-squares parabola of y on x over d(gene_id, x, y, ...), x centred: `fit` adds its value as trend.
PARABOLA = """mx AS (SELECT AVG(x) AS c FROM d), dz AS (SELECT d.*, x - c AS z FROM d CROSS JOIN mx),
q AS (SELECT COUNT(*)::DOUBLE AS s0, SUM(z) AS s1, SUM(z * z) AS s2, SUM(z * z * z) AS s3, SUM(z * z * z * z) AS s4, SUM(y) AS t0, SUM(z * y) AS t1, SUM(z * z * y) AS t2 FROM dz),
dt AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS whole FROM q),
co AS (SELECT (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / whole AS b0, (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / whole AS b1,
  (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / whole AS b2 FROM dt), fit AS (SELECT dz.*, b0 + b1 * z + b2 * z * z AS trend FROM dz CROSS JOIN co)"""


@register(QUERIES, f"+ {GENE_STATS}, d AS (SELECT gene_id, LOG2(mean) AS x, LOG2(sd / mean) AS y FROM gene_stats WHERE valid AND mean > 0 AND sd > 0), {PARABOLA} SELECT gene_id, ROW_NUMBER() OVER (ORDER BY y - trend DESC, gene_id)::INT AS rank FROM fit QUALIFY rank <= 200")
def top_dispersed_genes(spark, sf_dir):
    return select.by_dispersion(_gene_stats(spark, sf_dir), 200)


@register(QUERIES, f"+ {GENE_STATS}, d AS (SELECT gene_id, LOG10(mean) AS x, LOG10(sd * sd) AS y, mean FROM gene_stats WHERE mean > 0 AND sd > 0), {PARABOLA}, e AS (SELECT gene_id, mean, SQRT(POW(10, trend)) AS e, -mean / SQRT(POW(10, trend)) AS z0 FROM fit), p AS (SELECT gene_id, z0, LEAST((n - mean) / e, SQRT(nc)) AS z, nc FROM matrix JOIN e USING (gene_id) CROSS JOIN nc), a AS (SELECT gene_id, MAX(nc) AS nc, SUM(z) + (MAX(nc) - COUNT(*)) * MAX(z0) AS s, SUM(z * z) + (MAX(nc) - COUNT(*)) * MAX(z0) * MAX(z0) AS s2 FROM p GROUP BY 1) SELECT gene_id, ROW_NUMBER() OVER (ORDER BY (s2 - s * s / nc) / (nc - 1) DESC, gene_id)::INT AS rank FROM a QUALIFY rank <= 200")
def top_standardised_genes(spark, sf_dir):
    m, c, g = _load_once(spark, sf_dir)
    n = c.count()
    return select.by_standardised_variance(m, qc.gene_summary(m, g, n), n, 200)


@register(QUERIES, """+ bs AS (SELECT chemistry AS batch, COUNT(*) AS members FROM cells GROUP BY 1), sh AS (SELECT chemistry AS batch, gene_id, COUNT(*) AS k FROM matrix JOIN cells USING (cell_id) WHERE n > 0 GROUP BY 1, 2),
d AS (SELECT gene_id, MIN(COALESCE(k, 0)::DOUBLE / members) AS low, MAX(COALESCE(k, 0)::DOUBLE / members) AS high FROM genes CROSS JOIN bs LEFT JOIN sh USING (batch, gene_id) GROUP BY 1)
SELECT gene_id, ROUND(low, 6) AS low, ROUND(high, 6) AS high, NOT (CASE WHEN low = 0 THEN 0 ELSE high / low END > 4 OR CASE WHEN low = 0 THEN 0 ELSE high / low END < 0.25) AS stable FROM d""")
def batch_stable_genes(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    return select.batch_stable(m, c.select("cell_id", F.col("chemistry").alias("batch")), g).select("gene_id", _r("low"), _r("high"), "stable")


@register(QUERIES, f"+ {GENE_STATS}, {VARIANCE} SELECT gene_id, total_umis FROM rv JOIN gene_stats USING (gene_id) CROSS JOIN nc WHERE variance < 15 AND total_umis / nc > 0.5")
def housekeeping_genes(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    n = c.count()
    stats = residuals.residual_variance(m, g, n).join(qc.gene_summary(m, g, n), "gene_id")
    return qc.housekeeping(stats, n, 15.0, 0.5).select("gene_id", "total_umis")


@register(QUERIES, f"+ {CELL_STATS}, d AS (SELECT * FROM cell_stats JOIN cells USING (cell_id)) SELECT cluster_id, COUNT(*) AS n_cells, ROUND(AVG(age), 6) AS mean_age, ROUND(AVG(total_umis), 6) AS mean_umis, ROUND(VAR_POP(total_umis), 4) AS var_umis, ROUND(STDDEV_POP(doublet_score), 6) AS sd_doublet, SUM(n_genes)::BIGINT AS genes_seen, COUNT(*) FILTER (age <> 0) AS aged, ARG_MIN(region, cell_id) AS region FROM d GROUP BY 1")
def aggregate_vectors(spark, sf_dir):
    """Seven aggregations of one grouping in one pass."""
    m, c, g = _load(spark, sf_dir)
    d = qc.cell_summary(m, c, g).join(c, "cell_id")
    out = aggregate.aggregate_vector(
        d,
        "cluster_id",
        {"n_cells": ("age", "count"), "mean_age": ("age", "mean"), "mean_umis": ("total_umis", "mean"), "var_umis": ("total_umis", "variance"), "sd_doublet": ("doublet_score", "sd"), "genes_seen": ("n_genes", "sum"), "aged": ("age", "nnz"), "region": ("region", "first")},
    )
    return out.select("cluster_id", "n_cells", _r("mean_age"), _r("mean_umis"), _r("var_umis", 4), _r("sd_doublet"), "genes_seen", "aged", "region")


def _clusters(c: DataFrame) -> DataFrame:
    return c.select("cell_id", F.col("cluster_id").alias("group_id"))


@register(QUERIES, f"+ {GROUPS} SELECT group_id, gene_id, s AS sum, nnz, ROUND(mean, 6) AS mean, ROUND(SQRT(variance), 6) AS sd, count FROM grid")
def aggregate_matrix(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    return aggregate.aggregate_matrix(m, _clusters(c), g, ["sum", "nnz", "mean", "sd", "count"]).select("group_id", "gene_id", "sum", "nnz", _r("mean"), _r("sd"), "count")


@register(QUERIES, f"+ {ENRICHED} SELECT group_id, gene_id, ROUND(enrichment, 4) AS enrichment FROM enriched")
def enrichment(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    return enrich.enrichment_by(m, _clusters(c), g).select("group_id", "gene_id", _r("enrichment", 4))


@register(QUERIES, f"+ {ENRICHED.replace('cluster_id AS', 'chemistry AS')} SELECT group_id, gene_id, ROUND(enrichment, 4) AS enrichment FROM enriched")
def enrichment_by_label(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    return enrich.enrichment_by(m, c.select("cell_id", F.col("chemistry").alias("group_id")), g).select("group_id", "gene_id", _r("enrichment", 4))


def _trinaries(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    return enrich.trinarize(aggregate.aggregate_matrix(m, _clusters(c), g, ["nnz", "count"]))


@register(QUERIES, f"+ {TRINARIES} SELECT group_id, gene_id, ROUND(probability, 6) AS probability FROM trinaries")
def trinarize(spark, sf_dir):
    return _trinaries(spark, sf_dir).select("group_id", "gene_id", _r("probability"))


ANNOTATED = f"""{TRINARIES}, {TERM_SQL}, tok AS (SELECT term, LEFT(t, 1) AS sign, SUBSTR(t, 2) AS gene FROM (SELECT term, UNNEST(STRING_SPLIT(definition, ' ')) AS t FROM terms_)),
post AS (SELECT s.group_id, x.term, COALESCE(PRODUCT(CASE WHEN sign = '-' THEN 1 - probability ELSE probability END), 1) AS posterior
 FROM (SELECT DISTINCT group_id FROM grid) s CROSS JOIN terms_ x LEFT JOIN (tok JOIN genes USING (gene) JOIN trinaries USING (gene_id)) y ON y.term = x.term AND y.group_id = s.group_id GROUP BY 1, 2)"""


def _posteriors(spark, sf_dir):
    terms = spark.createDataFrame(TERM_VALUES, "term string, definition string")
    return enrich.annotate(_trinaries(spark, sf_dir), orders.genes(spark, sf_dir), terms)


@register(QUERIES, f"+ {ANNOTATED} SELECT group_id, term, ROUND(posterior, 6) AS posterior FROM post")
def auto_annotate(spark, sf_dir):
    return _posteriors(spark, sf_dir).select("group_id", "term", _r("posterior"))


@register(QUERIES, f"+ {ENRICHED}, sets AS (SELECT 'cc' AS set_name, gene_id FROM genes WHERE size BETWEEN 1 AND 9 UNION ALL SELECT 'promo', gene_id FROM genes WHERE type = 'PROMO'), d AS (SELECT e.group_id, n.set_name, e.gene_id, CASE WHEN s.gene_id IS NULL THEN 0 ELSE enrichment END AS e, CASE WHEN s.gene_id IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS miss FROM enriched e CROSS JOIN (SELECT DISTINCT set_name FROM sets) n LEFT JOIN sets s ON s.set_name = n.set_name AND s.gene_id = e.gene_id), r AS (SELECT group_id, set_name, COALESCE(SUM(e) OVER o / NULLIF(SUM(e) OVER p, 0), 0) - COALESCE(SUM(miss) OVER o / NULLIF(SUM(miss) OVER p, 0), 0) AS gap FROM d WINDOW p AS (PARTITION BY group_id, set_name), o AS (PARTITION BY group_id, set_name ORDER BY gene_id ROWS UNBOUNDED PRECEDING)) SELECT group_id, set_name, ROUND(MAX(gap), 6) AS score FROM r GROUP BY 1, 2")
def gene_set_scores(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    sets = g.where("size between 1 and 9").select(F.lit("cc").alias("set_name"), "gene_id").union(g.where("type = 'PROMO'").select(F.lit("promo"), "gene_id"))
    return enrich.gene_set_score(enrich.enrichment_by(m, _clusters(c), g), sets).select("group_id", "set_name", _r("score"))


DIFFERENTIAL = f"""{GROUPS.replace('cluster_id AS', 'chemistry AS')}, de AS (SELECT a.group_id AS g1, b.group_id AS g2, gene_id, a.mean AS m1, b.mean AS m2, a.nnz::DOUBLE / a.count AS f1, b.nnz::DOUBLE / b.count AS f2,
 COALESCE((a.mean - b.mean) / NULLIF(SQRT(COALESCE(a.variance / NULLIF(a.count - 1, 0), 0) + COALESCE(b.variance / NULLIF(b.count - 1, 0), 0)), 0), 0) AS t FROM grid a JOIN grid b USING (gene_id) WHERE a.group_id < b.group_id)"""


@register(QUERIES, f"+ {DIFFERENTIAL} SELECT g1, g2, gene_id, ROUND(t, 6) AS t FROM de")
def differential_expression(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    return enrich.differential(m, c.select("cell_id", F.col("chemistry").alias("group_id")), g).select("g1", "g2", "gene_id", _r("t"))


@register(QUERIES, f"+ {DIFFERENTIAL} SELECT g1, g2, COUNT(*) FILTER (ABS(t) > 1.5 AND GREATEST(m1, m2) >= 1.5 * LEAST(m1, m2) AND CASE WHEN m1 >= m2 THEN f1 ELSE f2 END > 0.01 AND CASE WHEN GREATEST(f1, f2) = 0 THEN 0 ELSE (CASE WHEN m1 >= m2 THEN f1 - f2 ELSE f2 - f1 END) / GREATEST(f1, f2) END > 0.3) AS n_genes FROM de GROUP BY 1, 2")
def binary_differential(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    tests = enrich.differential(m, c.select("cell_id", F.col("chemistry").alias("group_id")), g)
    return enrich.binary_differential(tests, 1.5, 1.5, 0.01, 0.3)


@register(QUERIES, "SELECT AVG(x) AS mean_x, ROUND(AVG(y), 6) AS mean_y, ROUND(VAR_POP(x), 6) AS var_x, ROUND(COVAR_POP(x, y), 6) AS cov_xy, ROUND(VAR_POP(y), 6) AS var_y FROM (SELECT age::DOUBLE AS x, doublet_score AS y FROM cells)".replace("SELECT AVG(x) AS", "SELECT ROUND(AVG(x), 6) AS"))
def gaussian_fit(spark, sf_dir):
    out = aggregate.gaussian(orders.cells(spark, sf_dir).select(F.col("age").cast("double").alias("x"), F.col("doublet_score").alias("y")), "x", "y")
    return out.select(*[_r(c) for c in out.columns])


@register(QUERIES, "+ d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY doublet_score DESC, cell_id) AS r FROM cells) SELECT sample_id, cell_id, region FROM d WHERE r = 1")
def drop_duplicates_first(spark, sf_dir):
    c = orders.cells(spark, sf_dir).select("sample_id", "cell_id", "region", "doublet_score")
    return aggregate.first_of(c, ["sample_id"], [-F.col("doublet_score"), F.col("cell_id")]).select("sample_id", "cell_id", "region")


@register(QUERIES, "+ d AS (SELECT DISTINCT region, DENSE_RANK() OVER (ORDER BY region) - 1 AS code FROM cells) SELECT cell_id, code FROM cells JOIN d USING (region)")
def label_encoder(spark, sf_dir):
    return aggregate.dense_labels(orders.cells(spark, sf_dir), "region", "code").select("cell_id", "code")


RENUMBERED = """+ d AS (SELECT DISTINCT chemistry, age, DENSE_RANK() OVER (PARTITION BY chemistry ORDER BY age) - 1 AS r FROM cells), k AS (SELECT chemistry, MAX(r) + 1 AS k FROM d GROUP BY 1),
o AS (SELECT chemistry, COALESCE(SUM(k) OVER (ORDER BY chemistry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM k) SELECT cell_id, (r + o)::BIGINT AS label FROM cells JOIN d USING (chemistry, age) JOIN o USING (chemistry)"""


@register(QUERIES, RENUMBERED)
def renumbered_labels(spark, sf_dir):
    return windows.renumber(orders.cells(spark, sf_dir), "chemistry", "age").select("cell_id", "label")


PLACED = "gs AS (SELECT gene_id, chromosome, start, total_umis::DOUBLE AS x FROM gene_stats JOIN genes USING (gene_id))"


@register(QUERIES, f"+ {GENE_STATS}, {PLACED}, i AS (SELECT *, ROW_NUMBER() OVER o AS i, COUNT(*) OVER (PARTITION BY chromosome) AS n, AVG(x) OVER (PARTITION BY chromosome ORDER BY start ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS f FROM gs WINDOW o AS (PARTITION BY chromosome ORDER BY start)) SELECT gene_id, ROUND(CASE WHEN i <= n - 19 THEN f ELSE MAX(CASE WHEN i = GREATEST(1, n - 19) THEN f END) OVER (PARTITION BY chromosome) END, 6) AS smoothed FROM i")
def windowed_mean(spark, sf_dir):
    g = _gene_stats(spark, sf_dir).join(orders.genes(spark, sf_dir), "gene_id").withColumn("x", F.col("total_umis").cast("double"))
    return windows.forward_mean(g, ["chromosome"], "start", "x", 20).select("gene_id", _r("smoothed"))


def _centred(spark, sf_dir, how):
    g = _gene_stats(spark, sf_dir).join(orders.genes(spark, sf_dir), "gene_id").withColumn("x", F.col("total_umis").cast("double"))
    return windows.centred(g, ["chromosome"], "start", "x", 25, how).select("gene_id", _r("smoothed"))


CENTRED = f"""+ {GENE_STATS}, {PLACED}, i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chromosome ORDER BY start) AS i, COUNT(*) OVER (PARTITION BY chromosome) AS n FROM gs),
b AS (SELECT gene_id, chromosome, CASE WHEN i - 12 < 1 THEN 1 WHEN i + 11 > n THEN n - LEAST(25, n) + 1 ELSE i - 12 END AS lo, CASE WHEN i - 12 < 1 THEN LEAST(25, n) WHEN i + 11 > n THEN n ELSE i + 11 END AS hi FROM i)
SELECT b.gene_id, ROUND(%s(x), 6) AS smoothed FROM b JOIN i ON i.chromosome = b.chromosome AND i.i BETWEEN lo AND hi GROUP BY 1"""


@register(QUERIES, CENTRED % "AVG")
def centred_mean(spark, sf_dir):
    return _centred(spark, sf_dir, "mean")


@register(QUERIES, CENTRED % "MEDIAN")
def centred_median(spark, sf_dir):
    return _centred(spark, sf_dir, "median")


@register(QUERIES, f"+ {GENE_STATS}, r AS (SELECT gene_id, ROW_NUMBER() OVER (ORDER BY total_umis, gene_id) - 1 - COUNT(*) OVER () % 30 AS r, COUNT(*) OVER () // 30 AS size FROM gene_stats) SELECT gene_id, (r // size)::BIGINT AS bin FROM r WHERE r >= 0")
def equal_bins(spark, sf_dir):
    return windows.equal_bins(_gene_stats(spark, sf_dir), "total_umis", "gene_id", 30).select("gene_id", F.col("bin").cast("bigint").alias("bin"))


SIGNATURE = f"""+ {GENE_STATS}, r AS (SELECT gene_id, ROW_NUMBER() OVER (ORDER BY total_umis, gene_id) - 1 - COUNT(*) OVER () % 30 AS r, COUNT(*) OVER () // 30 AS size FROM gene_stats),
bn AS (SELECT gene_id, r // size AS bin FROM r WHERE r >= 0), cn AS (SELECT bin, gene_id, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY MD5(gene_id::VARCHAR), gene_id) AS c FROM bn),
sets AS (SELECT 'a' AS set_name, gene_id FROM genes WHERE size = 1 UNION ALL SELECT 'b', gene_id FROM genes WHERE size = 2), ln AS (SELECT set_name, COUNT(*) AS len FROM sets GROUP BY 1),
wt AS (SELECT set_name, gene_id, SUM(w) AS w FROM (SELECT set_name, gene_id, 1.0::DOUBLE / len AS w FROM sets JOIN ln USING (set_name) UNION ALL
 SELECT s.set_name, cn.gene_id, -1.0::DOUBLE / (len * 20) FROM sets s JOIN bn USING (gene_id) JOIN ln USING (set_name) JOIN cn ON cn.bin = bn.bin WHERE c <= 20) GROUP BY 1, 2),
ct AS (SELECT cell_id, SUM(n) AS ct FROM matrix GROUP BY 1), raw AS (SELECT cell_id, set_name, SUM(n * 1000.0::DOUBLE / ct * w) AS s FROM matrix JOIN ct USING (cell_id) JOIN wt USING (gene_id) GROUP BY 1, 2),
ev AS (SELECT cell_id, set_name, COALESCE(s, 0) AS s FROM cells CROSS JOIN ln LEFT JOIN raw USING (cell_id, set_name)) SELECT cell_id, set_name, ROUND(s - AVG(s) OVER (PARTITION BY set_name), 6) AS score FROM ev"""


@register(QUERIES, SIGNATURE)
def signature_scores(spark, sf_dir):
    m, c, g = _load(spark, sf_dir)
    sets = g.where("size = 1").select(F.lit("a").alias("set_name"), "gene_id").union(g.where("size = 2").select(F.lit("b"), "gene_id"))
    return enrich.signature_scores(m, c, g, sets, n_controls=20).select("cell_id", "set_name", _r("score"))


@register(QUERIES, "+ pr AS (SELECT cluster_id AS item, gene_id, SUM(n)::DOUBLE AS x FROM matrix JOIN cells USING (cell_id) GROUP BY 1, 2), rf AS (SELECT DENSE_RANK() OVER (ORDER BY chemistry) AS ref, gene_id, SUM(n)::DOUBLE AS y FROM matrix JOIN cells USING (cell_id) GROUP BY chemistry, gene_id), c AS (SELECT item, ref, CORR(x, y) AS r FROM pr JOIN rf USING (gene_id) GROUP BY 1, 2) SELECT item, ARG_MAX(ref, r)::BIGINT AS ref, ROUND(MAX(r), 6) AS r FROM c GROUP BY 1")
def best_reference(spark, sf_dir):
    m, c, _ = _load(spark, sf_dir)
    d = m.join(c, "cell_id")
    profiles = d.groupBy(F.col("cluster_id").alias("item"), "gene_id").agg(F.sum("n").cast("double").alias("x"))
    refs = aggregate.dense_labels(d.groupBy("chemistry", "gene_id").agg(F.sum("n").cast("double").alias("y")), "chemistry", "ref").select((F.col("ref") + 1).alias("ref"), "gene_id", "y")
    return aggregate.best_reference(profiles, refs).select("item", "ref", _r("r"))
