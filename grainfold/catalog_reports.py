"""Queries on the tables behind reports, on graphs and on metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog_matrix as base
from .operators import aggregate, enrich, graph, qc, reports, windows
from .registry import register
from .sources import orders, workspace

QUERIES: dict = {}
_r = base._r


def _cells(spark, sf_dir):
    return base._qc_cells(spark, sf_dir)


def _enriched(spark, sf_dir):
    m, c, g = base._load(spark, sf_dir)
    return enrich.enrichment_by(m, base._clusters(c), g).select("group_id", "gene_id", F.round("enrichment", 6).alias("enrichment"))


RANKED = f"{base.ENRICHED}, rk AS (SELECT group_id, gene_id, ROW_NUMBER() OVER (PARTITION BY group_id ORDER BY ROUND(enrichment, 6) DESC, gene_id) AS rank FROM enriched)"
VALID = "COALESCE(NOT (doublet_score > 0.9) AND total_umis >= 500 AND mito_fraction < 0.1, FALSE)"


@register(QUERIES, f"+ {base.CELL_STATS}, d AS (SELECT *, {VALID} AS valid FROM cell_stats JOIN cells USING (cell_id)) SELECT COUNT(*) AS n_cells, COUNT(*) FILTER (NOT valid) AS n_invalid, ROUND(AVG((NOT valid)::INT::DOUBLE), 6) AS invalid_fraction, COUNT(*) FILTER (unspliced_fraction < 0.1) AS n_low_unspliced, ROUND(AVG(CASE WHEN total_umis > 0 THEN LOG10(total_umis) END), 6) AS mean_log10_umis, ROUND(AVG(CASE WHEN n_genes > 0 THEN LOG10(n_genes) END), 6) AS mean_log10_genes FROM d")
def report_qc(spark, sf_dir):
    out = reports.qc_report(qc.quality_control(_cells(spark, sf_dir), min_umis=500, max_mito=0.1))
    return out.select("n_cells", "n_invalid", _r("invalid_fraction"), "n_low_unspliced", _r("mean_log10_umis"), _r("mean_log10_genes"))


@register(QUERIES, f"{base.DROPLETS.replace('SELECT cell_id, CASE', ', dc AS (SELECT cell_id, CASE')}), n AS (SELECT cluster_id, droplet_class, COUNT(*) AS n FROM dc JOIN cells USING (cell_id) GROUP BY 1, 2) SELECT cluster_id, droplet_class, n, ROUND(100.0::DOUBLE * n / SUM(n) OVER (PARTITION BY cluster_id), 6) AS percent FROM n")
def report_droplet_classes(spark, sf_dir):
    d = qc.classify_droplets(_cells(spark, sf_dir), min_umis=500, max_doublet=0.9)
    return reports.class_shares(d, "cluster_id", "droplet_class").select("cluster_id", "droplet_class", "n", _r("percent"))


@register(QUERIES, f"+ {RANKED}, nm AS (SELECT group_id, STRING_AGG(gene, ' ' ORDER BY rank) AS names FROM rk JOIN genes USING (gene_id) WHERE rank <= 10 GROUP BY 1), pos AS (SELECT cluster_id AS group_id, COUNT(*) AS n, MEDIAN(age) AS x, MEDIAN(doublet_score) AS y FROM cells GROUP BY 1) SELECT group_id, group_id || ' (' || n || ' cells) ' || names AS label, x, ROUND(y, 6) AS y FROM pos JOIN nm USING (group_id)")
def report_manifold(spark, sf_dir):
    _, c, g = base._load(spark, sf_dir)
    d = c.withColumnRenamed("cluster_id", "group_id")
    return reports.manifold_labels(d, _enriched(spark, sf_dir), g, "age", "doublet_score").select("group_id", "label", "x", _r("y"))


SHARES = "s AS (SELECT row, col, n::DOUBLE / SUM(n) OVER (PARTITION BY row) AS s FROM h) SELECT row, col, ROUND(s / MAX(s) OVER (PARTITION BY col), 6) AS share FROM s"


@register(QUERIES, f"+ h AS (SELECT LEAST(age, 14) AS row, cluster_id AS col, COUNT(*) AS n FROM cells GROUP BY 1, 2), {SHARES}")
def report_age(spark, sf_dir):
    return reports.age_histogram(orders.cells(spark, sf_dir)).select("row", "col", _r("share"))


@register(QUERIES, f"+ {base.CELL_STATS}, h AS (SELECT GREATEST(0, LEAST(19, FLOOR(1000 * COALESCE(cell_cycle_fraction, 0))))::BIGINT AS row, cluster_id AS col, COUNT(*) AS n FROM cell_stats JOIN cells USING (cell_id) GROUP BY 1, 2), {SHARES}")
def report_cell_cycle(spark, sf_dir):
    return reports.cycle_histogram(_cells(spark, sf_dir)).select("row", "col", _r("share"))


@register(QUERIES, "+ n AS (SELECT r.region, k.cluster_id, COUNT(c.cell_id) AS n FROM (SELECT DISTINCT region FROM cells) r CROSS JOIN (SELECT DISTINCT cluster_id FROM cells) k LEFT JOIN cells c ON c.region = r.region AND c.cluster_id = k.cluster_id GROUP BY 1, 2) SELECT region, cluster_id, ROUND(n::DOUBLE / MAX(n) OVER (PARTITION BY cluster_id), 6) AS share FROM n")
def report_regions(spark, sf_dir):
    return reports.region_shares(orders.cells(spark, sf_dir)).select("region", "cluster_id", _r("share"))


@register(QUERIES, "+ n AS (SELECT r.sample_id, k.cluster_id, COUNT(c.cell_id) AS n FROM (SELECT DISTINCT sample_id FROM cells) r CROSS JOIN (SELECT DISTINCT cluster_id FROM cells) k LEFT JOIN cells c ON c.sample_id = r.sample_id AND c.cluster_id = k.cluster_id GROUP BY 1, 2) SELECT sample_id, cluster_id, ROUND(n::DOUBLE / MAX(n) OVER (PARTITION BY cluster_id), 6) AS share FROM n")
def report_subregions(spark, sf_dir):
    return reports.region_shares(orders.cells(spark, sf_dir), "sample_id").select("sample_id", "cluster_id", _r("share"))


@register(QUERIES, "SELECT cell_id, age AS x, doublet_score AS y, age, region, chemistry, sample_id, 'v3' AS kit FROM cells")
def report_batches(spark, sf_dir):
    return reports.batch_points(orders.cells(spark, sf_dir), "age", "doublet_score", ["age", "region", "chemistry", "sample_id", "kit", "donor"], {"kit": "v3"})


@register(QUERIES, f"+ {base.CELL_STATS} SELECT cluster_id, COUNT(*) AS n_cells, ROUND(AVG(COALESCE(total_umis, 0)), 6) AS mean_umis, ROUND(AVG(COALESCE(cell_cycle_fraction, 0)), 6) AS mean_cycle, ROUND(AVG(doublet_score), 6) AS mean_doublet FROM cell_stats JOIN cells USING (cell_id) GROUP BY 1")
def report_overview(spark, sf_dir):
    return reports.overview(_cells(spark, sf_dir)).select("cluster_id", "n_cells", _r("mean_umis"), _r("mean_cycle"), _r("mean_doublet"))


@register(QUERIES, "+ d AS (SELECT chemistry, ROW_NUMBER() OVER (ORDER BY chemistry) - 1 AS code FROM (SELECT DISTINCT chemistry FROM cells)), k AS (SELECT MAX(code) AS k FROM d) SELECT cell_id, i::INT AS place, (i = code)::INT AS value FROM cells JOIN d USING (chemistry) CROSS JOIN k CROSS JOIN RANGE(100) r(i) WHERE i < k")
def one_hot_batches(spark, sf_dir):
    d = aggregate.one_hot(orders.cells(spark, sf_dir), "chemistry")
    return d.select("cell_id", F.posexplode("one_hot").alias("place", "value"))


@register(QUERIES, f"+ {base.GROUPS}, t AS (SELECT group_id, SUM(mean) AS t FROM grid GROUP BY 1), m AS (SELECT MEDIAN(t) AS m FROM t) SELECT group_id, gene_id, ROUND(LOG10(mean * m / t + 0.001), 6) AS level FROM grid JOIN t USING (group_id) CROSS JOIN m WHERE gene_id < 40")
def report_markers(spark, sf_dir):
    m, c, g = base._load(spark, sf_dir)
    groups = aggregate.aggregate_matrix(m, base._clusters(c), g, ["mean"])
    return reports.marker_levels(groups, g.where("gene_id < 40")).select("group_id", "gene_id", _r("level"))


@register(QUERIES, f"+ {RANKED} SELECT group_id, STRING_AGG(gene, ' ' ORDER BY rank) AS names FROM rk JOIN genes USING (gene_id) WHERE rank <= 5 GROUP BY 1")
def report_top_genes(spark, sf_dir):
    return reports.top_gene_names(_enriched(spark, sf_dir), orders.genes(spark, sf_dir))


@register(QUERIES)
def report_heatmap(spark, sf_dir):
    return spark.createDataFrame(reports.heatmap_genes(_enriched(spark, sf_dir)), "group_id long, gene_id long")


STATES = "st AS (SELECT cell_id, age % 5 / 4.0::DOUBLE AS ac, doublet_score AS mes, cluster_id / 25.0::DOUBLE AS npc, (cell_id % 11) / 10.0::DOUBLE AS opc FROM cells), d AS (SELECT *, GREATEST(opc, npc) - GREATEST(ac, mes) AS d FROM st)"


@register(QUERIES, f"+ {STATES}, e AS (SELECT *, CASE WHEN d > 0 THEN opc - npc ELSE ac - mes END AS i FROM d WHERE d <> 0) SELECT cell_id, ROUND(SIGN(i) * LOG2(ABS(i) + 1), 6) AS x, ROUND(SIGN(d) * LOG2(ABS(d) + 1), 6) AS y FROM e")
def report_states(spark, sf_dir):
    c = orders.cells(spark, sf_dir)
    s = c.select("cell_id", (F.col("age") % 5 / 4.0).alias("ac"), F.col("doublet_score").alias("mes"), (F.col("cluster_id") / 25.0).alias("npc"), (F.col("cell_id") % 11 / 10.0).alias("opc"))
    return reports.two_axis_states(s).select("cell_id", _r("x"), _r("y"))


@register(QUERIES, f"+ {STATES}, l AS (SELECT cell_id, UNNEST(['ac', 'mes', 'npc', 'opc']) AS set_name, UNNEST([ac, mes, npc, opc]) - 0.3 AS score FROM st), c AS (SELECT set_name, QUANTILE_CONT(score, 0.99) AS cap FROM l GROUP BY 1) SELECT cell_id, set_name, ROUND(LEAST(GREATEST(score, 0), GREATEST(cap, 0)), 6) AS value FROM l JOIN c USING (set_name)")
def report_signatures(spark, sf_dir):
    c = orders.cells(spark, sf_dir)
    parts = {"ac": F.col("age") % 5 / 4.0, "mes": F.col("doublet_score"), "npc": F.col("cluster_id") / 25.0, "opc": F.col("cell_id") % 11 / 10.0}
    scores = c.select("cell_id", F.explode(F.array(*[F.struct(F.lit(k).alias("set_name"), (v - 0.3).alias("score")) for k, v in parts.items()])).alias("s")).select("cell_id", "s.*")
    return reports.capped_scores(scores).select("cell_id", "set_name", _r("value"))


@register(QUERIES, "+ per AS (SELECT doublet_score AS v, COUNT(*) AS k, COUNT(*) FILTER (chemistry = 'BUILDING') AS k1 FROM cells GROUP BY 1), r AS (SELECT *, COALESCE(SUM(k) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2.0::DOUBLE AS rank FROM per) SELECT (SUM(k) - SUM(k1))::BIGINT AS n0, SUM(k1)::BIGINT AS n1, SUM(rank * k1) - SUM(k1) * (SUM(k1) + 1) / 2.0::DOUBLE AS u FROM r")
def rank_sum_test(spark, sf_dir):
    c = orders.cells(spark, sf_dir).withColumn("g", (F.col("chemistry") == "BUILDING").cast("int"))
    return reports.rank_sum(c, "g", "doublet_score")


@register(QUERIES, "+ n AS (SELECT cluster_id, chemistry, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY COUNT(*) DESC, chemistry) AS r FROM cells GROUP BY 1, 2) SELECT cluster_id, chemistry FROM n WHERE r = 1")
def mode_of_cluster(spark, sf_dir):
    return reports.mode_of(orders.cells(spark, sf_dir), "cluster_id", "chemistry")


# --- collection, filters, metadata ----------------------------------------------------------------

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE")


@register(QUERIES, "+ s AS (SELECT *, CASE chemistry WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS source FROM cells WHERE (chemistry = 'AUTOMOBILE' AND age >= 5) OR (chemistry = 'BUILDING' AND NOT (age > 10 OR region = 'ASIA')) OR chemistry = 'FURNITURE'), r AS (SELECT DISTINCT source, cluster_id, DENSE_RANK() OVER (PARTITION BY source ORDER BY cluster_id) - 1 AS r FROM s), k AS (SELECT source, MAX(r) + 1 AS k FROM r GROUP BY 1), o AS (SELECT source, COALESCE(SUM(k) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM k) SELECT source::BIGINT * 1099511627776 + cell_id AS cell_id, source, age AS years, (r + o)::BIGINT AS cluster_id, 'v3' AS kit FROM s JOIN r USING (source, cluster_id) JOIN o USING (source)")
def collect_cells(spark, sf_dir):
    m, c, _ = base._load(spark, sf_dir)
    sources = [(m, c.where(F.col("chemistry") == s)) for s in SEGMENTS]
    filters = ["ws.age >= 5", "~(ws.age > 10 | ws.region == 'ASIA')", None]
    _, cells = workspace.collect_cells(sources, ["age->years", "cluster_id", "kit"], filters=filters, scalars=[{"kit": "v3"}] * 3, renumber=["cluster_id"])
    return cells.select("cell_id", "source", "years", "cluster_id", "kit")


@register(QUERIES, "+ s AS (SELECT cell_id FROM cells WHERE chemistry = 'AUTOMOBILE' AND age >= 5) SELECT gene_id, SUM(n)::BIGINT AS total FROM matrix JOIN s USING (cell_id) GROUP BY 1")
def collected_totals(spark, sf_dir):
    m, c, _ = base._load(spark, sf_dir)
    out, _ = workspace.collect_cells([(m, c.where("chemistry = 'AUTOMOBILE'"))], ["age"], filters=["ws.age >= 5"])
    return out.groupBy("gene_id").agg(F.sum("n").alias("total"))


@register(QUERIES, f"+ {base.ANNOTATED}, w AS (SELECT group_id, MAX(CASE WHEN term = 'A1' THEN posterior END) AS a1, MAX(CASE WHEN term = 'A3' THEN posterior END) AS a3, MAX(CASE WHEN term = 'A2' THEN posterior END) AS a2 FROM post GROUP BY 1) SELECT group_id FROM w WHERE (1 - a1 > 0.3 AND a3 > 0.3) OR a2 > 0.3")
def with_annotation(spark, sf_dir):
    return workspace.annotated_groups(base._posteriors(spark, sf_dir), "~A1 A3 | A2", 0.3)


@register(QUERIES, "SELECT DISTINCT c.sample_id, n_nationkey AS number, n_regionkey AS region_number FROM cells c JOIN nation ON LOWER(n_name) = LOWER(c.sample_id)")
def sample_metadata(spark, sf_dir):
    samples = orders.cells(spark, sf_dir).select("sample_id").distinct()
    table = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.upper("n_name").alias("Name"), F.col("n_nationkey").alias("Number"), F.col("n_regionkey").alias("Region_number"))
    return workspace.load_sample_metadata(samples, table, ["Number", "Region_number"])


@register(QUERIES, "SELECT cell_id, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE n_nationkey END::BIGINT AS number, COALESCE(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, '') AS label FROM cells JOIN nation ON n_name = sample_id")
def patch_sample_metadata(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    number = F.when(F.col("n_nationkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("n_nationkey").cast("double"))
    table = nation.select(F.col("n_name").alias("sample_id"), number.alias("number"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("label"))
    return workspace.patch_sample_metadata(orders.cells(spark, sf_dir), table, {"number": "bigint", "label": "string"}).select("cell_id", "number", "label")


@register(QUERIES, "+ t AS (SELECT 'ACC' || (p_partkey // 2 * 2) || '.1' AS accession, p_name AS full_name, p_type = 'PROMO' AS is_tf FROM part), f AS (SELECT accession, MIN(ROW(full_name, is_tf)) AS v FROM t GROUP BY 1) SELECT gene_id, COALESCE(v[1], '') AS full_name, COALESCE(v[2], FALSE) AS is_tf FROM genes LEFT JOIN f USING (accession)")
def patch_gene_metadata(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.concat(F.lit("ACC"), (F.floor(F.col("p_partkey") / 2) * 2).cast("string"), F.lit(".1"))
    table = part.select(key.alias("accession"), F.col("p_name").alias("full_name"), (F.col("p_type") == "PROMO").alias("is_tf"))
    return workspace.patch_gene_metadata(orders.genes(spark, sf_dir), table).select("gene_id", "full_name", "is_tf")


# --- graphs and metrics -----------------------------------------------------------------------------

VECTORS = "v AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings)"
KNN = f"{VECTORS}, p AS (SELECT a.cell_id AS src, b.cell_id AS dst, LIST_DISTANCE(a.vec, b.vec) AS dist FROM v a JOIN v b ON a.cell_id <> b.cell_id), nn AS (SELECT src, dst, dist, ROW_NUMBER() OVER (PARTITION BY src ORDER BY dist, dst)::INT AS rank FROM p QUALIFY rank <= 10)"


@register(QUERIES, f"WITH {KNN} SELECT src, rank, dst, ROUND(dist, 6) AS dist FROM nn", prefix="")
def knn(spark, sf_dir):
    return graph.knn(orders.factors(spark, sf_dir), 10).select("src", "rank", "dst", _r("dist"))


@register(QUERIES, f"WITH {KNN}, w AS (SELECT src, dst, 1 - dist AS weight FROM nn) SELECT a.src, a.dst, ROUND(LEAST(a.weight, b.weight), 6) AS weight FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src", prefix="")
def mutual_graph(spark, sf_dir):
    e = graph.knn(orders.factors(spark, sf_dir), 10).select("src", "dst", (1 - F.col("dist")).alias("weight"))
    return graph.mutual(e).select("src", "dst", _r("weight"))


@register(QUERIES, f"WITH {KNN}, t AS (SELECT MAX(dist) AS dmax FROM nn), s AS (SELECT src, dst, (dmax - dist) / dmax AS weight FROM nn CROSS JOIN t), r AS (SELECT QUANTILE_CONT(1 - weight, 0.9) AS radius FROM s) SELECT src, dst, ROUND(weight, 6) AS weight, ROUND(radius, 6) AS radius FROM s CROSS JOIN r WHERE weight > 1 - radius", prefix="")
def radius_graph(spark, sf_dir):
    return graph.radius_graph(graph.knn(orders.factors(spark, sf_dir), 10)).select("src", "dst", _r("weight"), _r("radius"))


@register(QUERIES, f"WITH {KNN} SELECT src AS cell_id, ROUND(AVG(label), 6) AS label FROM nn JOIN v ON v.cell_id = dst GROUP BY 1", prefix="")
def smoothed_labels(spark, sf_dir):
    f = orders.factors(spark, sf_dir)
    return graph.smooth(f.select("cell_id", F.col("label").cast("double").alias("label")), graph.row_weights(graph.knn(f, 10)), "label").select("cell_id", _r("label"))


@register(QUERIES)
def balanced_knn(spark, sf_dir):
    """Every cell has at most 5 outgoing and 8 incoming edges among 20 near cells."""
    return graph.balance(graph.knn_approximate(orders.factors(spark, sf_dir), 20), 5, 8)


@register(QUERIES, f"WITH RECURSIVE {KNN}, e AS (SELECT src, dst FROM nn WHERE dist < 1.1 AND rank <= 2), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), walk(id, seen) AS (SELECT DISTINCT src, src FROM b UNION SELECT walk.id, b.dst FROM walk JOIN b ON walk.seen = b.src) SELECT id, MIN(seen) AS component FROM walk GROUP BY 1", prefix="")
def connected_components(spark, sf_dir):
    e = graph.knn(orders.factors(spark, sf_dir), 2).where("dist < 1.1")
    return graph.connected_components(e)


PROFILES = "pf AS (SELECT label, LIST_TRANSFORM(LIST(s ORDER BY j), lambda x: x / t) AS p FROM (SELECT label, j, SUM(ABS(vec[j])) AS s, SUM(SUM(ABS(vec[j]))) OVER (PARTITION BY label) AS t FROM v CROSS JOIN RANGE(1, 65) r(j) GROUP BY 1, 2) GROUP BY label, t)"


@register(QUERIES, f"WITH {VECTORS}, {PROFILES}, x AS (SELECT a.label AS a, b.label AS b, UNNEST(a.p) AS p, UNNEST(b.p) AS q FROM pf a JOIN pf b ON a.label < b.label) SELECT a, b, ROUND(SUM(p * LOG2(p / q)), 6) AS kl, ROUND(SUM(p * LOG2(2 * p / (p + q)) + q * LOG2(2 * q / (p + q))) / 2, 6) AS js, ROUND(POW(SUM(POW(ABS(p - q), 10)), 0.1), 6) AS minkowski10, ROUND(SQRT(SUM((p - q) * (p - q))), 6) AS euclidean, ROUND(1 - SUM(p * q) / SQRT(SUM(p * p)) / SQRT(SUM(q * q)), 6) AS cosine FROM x GROUP BY 1, 2", prefix="")
def profile_distances(spark, sf_dir):
    f = orders.factors(spark, sf_dir).select("label", F.posexplode("vec").alias("j", "x")).groupBy("label", "j").agg(F.sum(F.abs("x")).alias("s"))
    lists = f.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("l"), F.sum("s").alias("t"))
    p = lists.select("label", F.transform("l", lambda e: e["s"] / F.col("t")).alias("p"))
    a, b = p.withColumnsRenamed({"label": "a", "p": "p"}), p.withColumnsRenamed({"label": "b", "p": "q"})
    d = a.join(b, F.col("a") < F.col("b"))
    x, y = F.col("p"), F.col("q")
    made = {"kl": graph.kullback_leibler(x, y), "js": graph.jensen_shannon(x, y), "minkowski10": graph.minkowski(x, y), "euclidean": graph.euclidean(x, y), "cosine": graph.cosine(x, y)}
    return d.select("a", "b", *[F.round(v, 6).alias(k) for k, v in made.items()])


@register(QUERIES, f"+ {base.LOG2}, e AS (SELECT cell_id AS src, cell_id + 1 AS dst, 1.0::DOUBLE + cell_id % 3 AS weight FROM cells WHERE cell_id + 1 IN (SELECT cell_id FROM cells)), g AS (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e), dg AS (SELECT src AS cell_id, SUM(weight) AS d FROM g GROUP BY 1), vol AS (SELECT SUM(d) AS volume FROM dg), dx AS (SELECT gene_id, SUM(d * value) AS dx, SUM(d * value * value) AS xdx FROM l2 JOIN dg USING (cell_id) GROUP BY 1), xw AS (SELECT a.gene_id, SUM(a.value * b.value * weight) AS xwx FROM l2 a JOIN g ON a.cell_id = src JOIN l2 b ON b.cell_id = dst AND a.gene_id = b.gene_id GROUP BY 1) SELECT gene_id, ROUND(1 - (COALESCE(xwx, 0) - dx * dx / volume) / CASE WHEN ABS(xdx - dx * dx / volume) < 1e-12 THEN 1e4 ELSE xdx - dx * dx / volume END, 6) AS score FROM dx LEFT JOIN xw USING (gene_id) CROSS JOIN vol")
def laplacian_scores(spark, sf_dir):
    from .operators import residuals, select

    m, c, _ = base._load(spark, sf_dir)
    ids = c.select("cell_id")
    e = ids.select(F.col("cell_id").alias("src"), (F.col("cell_id") + 1).alias("dst"), (1.0 + F.col("cell_id") % 3).alias("weight")).join(ids.withColumnRenamed("cell_id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    e = e.union(e.select("dst", "src", "weight"))
    return select.laplacian_score(residuals.log2_normalised(m, c), e).select("gene_id", _r("score"))
