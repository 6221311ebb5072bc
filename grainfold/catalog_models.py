"""Queries on iterative models: their results are properties, not rows of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog_matrix as base
from .operators import aggregate, cluster, density, doublets, enrich, factor, genome, graph, leiden, merged_pca, qc, reports, residuals, select, stockholm, umap, windows
from .registry import register
from .sources import orders

QUERIES: dict = {}


def _positive_residuals(spark, sf_dir, n_genes=200):
    m, c, g = base._load(spark, sf_dir)
    n = c.count()
    chosen = select.by_residuals(residuals.residual_variance(m, g, n), qc.gene_summary(m, g, n), n_genes)
    r = residuals.pearson(m, n, low="zero").select("cell_id", "gene_id", F.col("residual").alias("value"))
    return r, chosen, c


@register(QUERIES)
def residuals_pca(spark, sf_dir):
    """Principal components of the positive residuals of the selected genes."""
    r, chosen, c = _positive_residuals(spark, sf_dir)
    return factor.principal_components(factor.cell_vectors(r, chosen, c), 20)[0]


@register(QUERIES)
def merged_components(spark, sf_dir):
    """Principal components of the positive residuals by merging partial decompositions."""
    r, chosen, c = _positive_residuals(spark, sf_dir)
    return merged_pca.merged_components(r, chosen, c, 20)[0]


@register(QUERIES)
def principal_components(spark, sf_dir):
    m, c, g = base._load(spark, sf_dir)
    chosen = select.by_dispersion(qc.gene_summary(m, g, c.count()), 200)
    return factor.principal_components(factor.cell_vectors(residuals.log2_normalised(m, c), chosen, c), 20, standardise=True)[0]


@register(QUERIES)
def topic_model(spark, sf_dir):
    return factor.topics(orders.tokens(spark, sf_dir), 5)[0]


@register(QUERIES)
def poisson_factors(spark, sf_dir):
    m, _, _ = base._load(spark, sf_dir)
    return factor.poisson_factors(m, 4)[0]


@register(QUERIES)
def batch_corrected(spark, sf_dir):
    f = orders.factors(spark, sf_dir)
    return factor.harmonise(f.select("cell_id", "vec"), f.select("cell_id", (F.col("cell_id") % 3).cast("string").alias("batch")))


def _graph(spark, sf_dir):
    e = graph.knn_approximate(orders.factors(spark, sf_dir), 15).select("src", "dst", F.lit(1.0).alias("weight"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


@register(QUERIES)
def communities(spark, sf_dir):
    return cluster.communities(_graph(spark, sf_dir))


@register(QUERIES)
def leiden_communities(spark, sf_dir):
    """Communities of the neighbour graph by moves, refinement and contraction."""
    return leiden.leiden(_graph(spark, sf_dir))


def _plane(spark, sf_dir):
    f = orders.factors(spark, sf_dir)
    return f.select("cell_id", F.col("label").alias("grp"), f.vec[0].alias("x"), f.vec[1].alias("y"))


@register(QUERIES, """WITH RECURSIVE v AS (SELECT vec_id AS cell_id, label::BIGINT AS grp, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
near AS (SELECT a.cell_id AS a, b.cell_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS far FROM v a JOIN v b ON a.grp = b.grp WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.07::DOUBLE * 0.07::DOUBLE),
core AS (SELECT a AS id FROM near GROUP BY a HAVING COUNT(*) >= 6), linked AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS lead FROM core UNION SELECT linked.b, reach.lead FROM reach JOIN linked ON linked.a = reach.id), leads AS (SELECT id, MIN(lead) AS lead FROM reach GROUP BY id),
border AS (SELECT a AS id, ARG_MIN(lead, {'far': far, 'id': b}) AS lead FROM near JOIN leads ON leads.id = b WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
SELECT cell_id, leads.id IS NOT NULL AS core, COALESCE(leads.lead, border.lead) AS leader FROM v LEFT JOIN leads ON leads.id = cell_id LEFT JOIN border ON border.id = cell_id""", prefix="")
def density_clusters(spark, sf_dir):
    """Density clusters of each label on two factors; a cluster is named by its least core point."""
    found = density.dbscan(_plane(spark, sf_dir).withColumns({"eps": F.lit(0.07), "least": F.lit(6).cast("long")}))
    lead = found.where("core").groupBy("grp", "cluster").agg(F.min("cell_id").alias("leader"))
    return found.join(lead, ["grp", "cluster"], "left").select("cell_id", "core", "leader")


@register(QUERIES)
def broken_clusters(spark, sf_dir):
    """Labels on two factors, the dispersed ones split by density."""
    p = _plane(spark, sf_dir)
    return density.break_clusters(p.select("cell_id", F.col("grp").alias("label")), p.select("cell_id", "x", "y"))


@register(QUERIES)
def polished_clusters(spark, sf_dir):
    near = graph.knn_approximate(orders.factors(spark, sf_dir), 15)
    e = near.select("src", "dst", F.lit(1.0).alias("weight"))
    labels = cluster.communities(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    return cluster.polish(labels, near, 20)


@register(QUERIES, """+ m AS (SELECT cluster_id, MEDIAN(age) AS ma, MEDIAN(doublet_score) AS md FROM cells GROUP BY 1), d AS (SELECT cluster_id, MEDIAN(ABS(age - ma)) AS da, MEDIAN(ABS(doublet_score - md)) AS dd FROM cells JOIN m USING (cluster_id) GROUP BY 1)
SELECT cell_id, COALESCE(0.6745::DOUBLE * ABS(age - ma) / NULLIF(da, 0), 0) > 1.2 OR COALESCE(0.6745::DOUBLE * ABS(doublet_score - md) / NULLIF(dd, 0), 0) > 1.2 AS outlier FROM cells JOIN m USING (cluster_id) JOIN d USING (cluster_id)""")
def outliers(spark, sf_dir):
    c = orders.cells(spark, sf_dir).select("cell_id", "cluster_id", "age", "doublet_score")
    return cluster.iglewicz_hoaglin(c, ["age", "doublet_score"], 1.2, "cluster_id").select("cell_id", "outlier")


def _tree(spark, sf_dir):
    m, c, g = base._load(spark, sf_dir)
    g = base._no_broadcast(g)
    groups = aggregate.aggregate_matrix(m, base._clusters(c), g, ["mean", "nnz", "count"])
    n = c.count()
    chosen = select.by_residuals(residuals.residual_variance(m, g, n), qc.gene_summary(m, g, n), 200)
    return groups, *cluster.dendrogram(groups, chosen), c


@register(QUERIES)
def dendrogram(spark, sf_dir):
    _, _, linkage, _ = _tree(spark, sf_dir)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(linkage)], "step int, left int, right int, dist double, size int")


@register(QUERIES)
def ordered_clusters(spark, sf_dir):
    """The clusters' numbers in the optimal order of the leaves."""
    _, ids, linkage, _ = _tree(spark, sf_dir)
    return spark.createDataFrame([(ids[i], place) for place, i in enumerate(cluster.leaves(linkage) if ids else [])], "cluster_id long, place long")


@register(QUERIES)
def cut_dendrogram(spark, sf_dir):
    _, ids, linkage, c = _tree(spark, sf_dir)
    sizes = {r.cluster_id: r["count"] for r in c.groupBy("cluster_id").count().collect()}
    of = cluster.subtrees(sizes, ids, linkage, 4, min_cells=max(1, c.count() // 20))
    codes = spark.createDataFrame(list(of.items()), "cluster_id long, subtree long")
    return c.join(F.broadcast(codes), "cluster_id").select("cell_id", "subtree")


@register(QUERIES)
def multilevel_enrichment(spark, sf_dir):
    groups, ids, linkage, _ = _tree(spark, sf_dir)
    levels = []
    for k in (3, len(ids)):
        codes = spark.createDataFrame(list(zip(ids, cluster.cut(linkage, k) if ids else [], strict=True)), "group_id long, new long")
        d = groups.join(F.broadcast(codes), "group_id").groupBy("new", "gene_id").agg((F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("mean"), F.sum("nnz").alias("nnz"), F.sum("count").alias("count"))
        levels.append(enrich.enrichment(d.withColumnRenamed("new", "group_id")).select("group_id", "gene_id", F.round("enrichment", 6).alias("enrichment")))
    return spark.createDataFrame(select.by_multilevel_enrichment(levels, [5, 2]), "level int, group_id long, gene_id long")


@register(QUERIES)
def cluster_validation(spark, sf_dir):
    return cluster.validate(orders.factors(spark, sf_dir))


@register(QUERIES)
def bisection(spark, sf_dir):
    r, chosen, _ = _positive_residuals(spark, sf_dir)
    return cluster.bisect(r.join(chosen.select("gene_id"), "gene_id", "left_semi").where("value > 0"))


@register(QUERIES)
def recursive_bisection(spark, sf_dir):
    """Clusters of recursive normalised cuts, before and after the cut of their tree."""
    m, c, g = base._load_once(spark, sf_dir)
    return stockholm.stockholm(m, c, g)[0]


def _karyotype(spark, sf_dir):
    m, c, g = base._load_once(spark, sf_dir)
    g, n = base._no_broadcast(g), c.count()
    keep = qc.housekeeping(residuals.residual_variance(m, g, n).join(qc.gene_summary(m, g, n), "gene_id"), n, 1e9, 0.0).select("gene_id")
    groups = aggregate.aggregate_matrix(m, base._clusters(c), g, ["mean"]).join(keep, "gene_id", "left_semi")
    reference = spark.range(5).select(F.col("id").alias("group_id"))
    return cluster.karyotype(groups, g, reference), g


@register(QUERIES, f"""+ {base.GROUPS}, t AS (SELECT group_id, SUM(mean) AS t FROM grid GROUP BY 1), md AS (SELECT MEDIAN(t) AS m FROM t),
x AS (SELECT group_id, gene_id, chromosome, start, CASE WHEN t = 0 THEN 0 ELSE mean * m / t END AS x FROM grid JOIN t USING (group_id) CROSS JOIN md JOIN genes USING (gene_id)),
i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY group_id, chromosome ORDER BY start) AS i, COUNT(*) OVER (PARTITION BY group_id, chromosome) AS n, AVG(x) OVER (PARTITION BY group_id, chromosome ORDER BY start ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS f FROM x),
y AS (SELECT group_id, gene_id, CASE WHEN i <= n - 19 THEN f ELSE MAX(CASE WHEN i = GREATEST(1, n - 19) THEN f END) OVER (PARTITION BY group_id, chromosome) END AS y FROM i),
r AS (SELECT gene_id, AVG(y) AS r FROM y WHERE group_id < 5 GROUP BY 1), p AS (SELECT group_id, gene_id, 2 * COALESCE(y / NULLIF(r, 0), 0) * COALESCE(AVG(r) OVER (PARTITION BY group_id) / NULLIF(AVG(y) OVER (PARTITION BY group_id), 0), 0) AS ploidy FROM y JOIN r USING (gene_id))
SELECT group_id, gene_id, ROUND(ploidy, 4) AS ploidy FROM p""")
def karyotype(spark, sf_dir):
    return _karyotype(spark, sf_dir)[0].select("group_id", "gene_id", F.round("ploidy", 4).alias("ploidy"))


@register(QUERIES)
def copy_numbers(spark, sf_dir):
    k, g = _karyotype(spark, sf_dir)
    return cluster.viterbi(k.join(g.select("gene_id", "start"), "gene_id").select("group_id", "gene_id", "start", "ploidy"), ["group_id"], "start", "ploidy")


@register(QUERIES)
def hmm_karyotype(spark, sf_dir):
    """Best reference, metacell and place of every cell, with the genes that its metacell has gained and lost, from ploidies against the clusters' mean profiles."""
    m, c, g = base._load_once(spark, sf_dir)
    means = aggregate.aggregate_matrix(m, base._clusters(c), g, ["mean"])
    references = means.select((F.col("group_id") % 2).alias("source"), F.col("group_id").alias("ref"), "gene_id", "mean")
    found = genome.hmm_karyotype(m, c, g, references)
    changed = found.metacells.groupBy("metacell").agg(F.count_if(F.col("state") > 2).alias("gained"), F.count_if(F.col("state") < 2).alias("lost"))
    return found.cells.join(changed, "metacell").select("cell_id", "reference", "metacell", "place", "gained", "lost")


@register(QUERIES)
def report_karyotype(spark, sf_dir):
    """Ploidies and copy numbers by group and gene with the side of the groups' top split."""
    return reports.ploidy_sides(copy_numbers(spark, sf_dir))


@register(QUERIES)
def smoothed_karyotype(spark, sf_dir):
    k, g = _karyotype(spark, sf_dir)
    placed = k.join(g.select("gene_id", "chromosome", "start"), "gene_id").select("group_id", "gene_id", "chromosome", "start", "ploidy")
    return windows.lowess(placed, ["group_id", "chromosome"], "start", "ploidy", 100)


@register(QUERIES)
def gene_set_p_values(spark, sf_dir):
    m, c, g = base._load(spark, sf_dir)
    sets = g.where("size between 1 and 9").select(F.lit("cc").alias("set_name"), "gene_id").union(g.where("type = 'PROMO'").select(F.lit("promo"), "gene_id"))
    return enrich.gene_set_p(enrich.enrichment_by(m, base._clusters(c), g), sets)


RANDOM_SETS = base.SIGNATURE.replace("SELECT 'a' AS set_name, gene_id FROM genes WHERE size = 1 UNION ALL SELECT 'b', gene_id FROM genes WHERE size = 2", "SELECT set_name, gene_id FROM (SELECT j AS set_name, gene_id, ROW_NUMBER() OVER (PARTITION BY j ORDER BY MD5(j || ':' || gene_id), gene_id) AS r FROM genes CROSS JOIN RANGE(100) x(j)) WHERE r <= 100")


@register(QUERIES, RANDOM_SETS.replace(" SELECT cell_id, set_name, ROUND(s - AVG(s) OVER (PARTITION BY set_name), 6) AS score FROM ev", ", sc AS (SELECT cell_id, s - AVG(s) OVER (PARTITION BY set_name) AS score FROM ev) SELECT cell_id, ROUND(QUANTILE_CONT(score, 0.99), 6) AS threshold FROM sc GROUP BY 1"))
def signature_thresholds(spark, sf_dir):
    m, c, g = base._load(spark, sf_dir)
    return enrich.signature_bootstrap(m, c, g, n_controls=20).select("cell_id", F.round("threshold", 6).alias("threshold"))


@register(QUERIES)
def corrected_differential(spark, sf_dir):
    """Welch tests of all pairs of batches with p and its step-up correction within the pair."""
    m, c, g = base._load(spark, sf_dir)
    return enrich.with_q(enrich.differential(m, c.select("cell_id", F.col("chemistry").alias("group_id")), g)).select("g1", "g2", "gene_id", "t", "df", "p", "q")


@register(QUERIES)
def corrected_binary_differential(spark, sf_dir):
    m, c, g = base._load(spark, sf_dir)
    tests = enrich.with_q(enrich.differential(m, c.select("cell_id", F.col("chemistry").alias("group_id")), g))
    return enrich.binary_differential(tests, min_fold=1.5, min_share=0.01, min_gap=0.3, max_q=0.5)


@register(QUERIES)
def classified_clusters(spark, sf_dir):
    """Communities of cells; small ones reclassified, with a second label and both probabilities."""
    return cluster.classify(communities(spark, sf_dir), orders.factors(spark, sf_dir).select("cell_id", "vec"), 20)


@register(QUERIES)
def doublet_finder(spark, sf_dir):
    m, c, g = base._load(spark, sf_dir)
    return doublets.doublet_scores(m, c, g)


@register(QUERIES)
def cell_hashes(spark, sf_dir):
    m, c, g = base._load(spark, sf_dir)
    return doublets.cell_hashes(m, c, g)


@register(QUERIES)
def embedding(spark, sf_dir):
    return doublets.embed(orders.factors(spark, sf_dir).select("cell_id", "vec"))


@register(QUERIES)
def umap_layout(spark, sf_dir):
    """A layout of the cells by attraction along neighbour edges and sampled repulsion."""
    return umap.umap(orders.factors(spark, sf_dir))


@register(QUERIES, """WITH v AS (SELECT vec_id AS cell_id, label::DOUBLE AS level, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), e AS (SELECT MIN(level) AS low, MAX(level) AS high FROM v),
r AS (SELECT cell_id, x, y, SQRT(x * x + y * y) AS radius, 0.6::DOUBLE + 0.35::DOUBLE * (cell_id * 7919 % 1000)::DOUBLE / 1000::DOUBLE AS f, 0.5::DOUBLE * (level - low) / (high - low) AS target FROM v CROSS JOIN e)
SELECT cell_id, ROUND(x * (f * target + (1 - f) * radius) / radius, 6) AS x, ROUND(y * (f * target + (1 - f) * radius) / radius, 6) AS y FROM r""", prefix="")
def pulled_places(spark, sf_dir):
    """Places on two factors pulled towards radii by label."""
    p = _plane(spark, sf_dir)
    force = 0.6 + 0.35 * (F.col("cell_id") * 7919 % 1000) / 1000.0
    out = umap.pull_towards_levels(p, p.select("cell_id", F.col("grp").alias("level")), force=force)
    return out.select("cell_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(QUERIES)
def poisson_glm_factors(spark, sf_dir):
    from .operators import glmpca

    m, c, g = base._load(spark, sf_dir)
    chosen = select.by_dispersion(qc.gene_summary(m, g, c.count()), 100)
    return glmpca.poisson_glm_factors(m, 3, genes=chosen)[0]


@register(QUERIES)
def uniform_scaling(spark, sf_dir):
    from .operators import special

    m, c, _ = base._load(spark, sf_dir)
    return special.uniform_scaling(m, c.count())[1]


@register(QUERIES)
def expressed_above(spark, sf_dir):
    from .operators import special

    m, c, g = base._load(spark, sf_dir)
    groups = aggregate.aggregate_matrix(m, base._clusters(c), g, ["mean", "count"])
    total = qc.cell_summary(m, c, g).select("cell_id", "total_umis").join(base._clusters(c), "cell_id")
    mid = F.broadcast(total.agg(F.median("total_umis").alias("m")))
    sizes = total.crossJoin(mid).groupBy("group_id").agg(F.sum(F.col("total_umis") / F.col("m")).alias("size"))
    return special.expressed_above(groups, sizes)


PAIRS = "ct2 AS (SELECT label, LIST(s ORDER BY j) AS p FROM (SELECT label, j, ROUND(SUM(ABS(vec[j])) * 10) AS s FROM v CROSS JOIN RANGE(1, 65) r(j) GROUP BY 1, 2) GROUP BY label), x AS (SELECT a.label AS a, b.label AS b, UNNEST(a.p) AS p, UNNEST(b.p) AS q FROM ct2 a JOIN ct2 b ON a.label < b.label)"


@register(QUERIES, f"WITH v AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings), {PAIRS}, t AS (SELECT a, b, SUM(p) AS tp, SUM(q) AS tq FROM x GROUP BY 1, 2), s AS (SELECT x.a, x.b, SUM(POW(ABS((SQRT(p * 5000 / tp) + 0.8 * SQRT(p * 5000 / tp + 1)) / 1.8 - (SQRT(q * 5000 / tq) + 0.8 * SQRT(q * 5000 / tq + 1)) / 1.8), 10)) AS mk, SUM(LGAMMA(2 + p + q) - LGAMMA(2 + p) - LGAMMA(2 + q) + LGAMMA(2.0::DOUBLE) - 2 * LN(3 + 3 * tq / tp + 1) + 2 * LN(4 * (3 * tq / tp + 1))) + MAX(tp * LN(tq / tp) + (tp + tq) * LN(3 / (3 + 3 * tq / tp + 1)) - tp * LN((3 * tq / tp) / (3 * tq / tp + 1)) - tq * LN(3.0::DOUBLE / 4)) AS px FROM x JOIN t ON x.a = t.a AND x.b = t.b GROUP BY 1, 2) SELECT a, b, ROUND(POW(mk, 0.1), 6) AS stabilised, ROUND(px, 4) AS proximity FROM s", prefix="")
def count_distances(spark, sf_dir):
    from .operators import special

    f = orders.factors(spark, sf_dir).select("label", F.posexplode("vec").alias("j", "x")).groupBy("label", "j").agg(F.round(F.sum(F.abs("x")) * 10).alias("s"))
    p = f.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda e: e["s"]).alias("p"))
    d = p.withColumnRenamed("label", "a").join(p.withColumnsRenamed({"label": "b", "p": "q"}), F.col("a") < F.col("b"))
    return d.select("a", "b", F.round(special.stabilised_minkowski(F.col("p"), F.col("q")), 6).alias("stabilised"), F.round(special.poisson_proximity(2.0, 3.0)("p", "q"), 4).alias("proximity"))


WHOLE_PAIRS = "ct3 AS (SELECT label, LIST(s ORDER BY j) AS p FROM (SELECT label, j, ROUND(SUM(ABS(vec[j]))) AS s FROM v CROSS JOIN RANGE(1, 65) r(j) GROUP BY 1, 2) GROUP BY label), x AS (SELECT a.label AS a, b.label AS b, UNNEST(a.p) AS p, UNNEST(b.p) AS q FROM ct3 a JOIN ct3 b ON a.label < b.label)"
EVIDENCE = "LGAMMA({n}) + LGAMMA(SUM(p) + SUM(q) + {n}) - LGAMMA(SUM(p) + {n}) - LGAMMA(SUM(q) + {n}) + SUM(LGAMMA(p + 1) + LGAMMA(q + 1) - LGAMMA(p + q + 1))"


@register(QUERIES, f"WITH v AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings), {WHOLE_PAIRS}, s AS (SELECT a, b, {EVIDENCE.format(n='COUNT(*)::DOUBLE')} AS w, {EVIDENCE.format(n='(COUNT(*) FILTER (p > 0 OR q > 0))::DOUBLE')} AS sub FROM x GROUP BY 1, 2) SELECT a, b, ROUND(1 - 1 / (1 + EXP(LEAST(w, 700))), 6) AS distance, ROUND(1 - 1 / (1 + EXP(LEAST(sub, 700))), 6) AS subspace FROM s", prefix="")
def multinomial_distances(spark, sf_dir):
    from .operators import special

    f = orders.factors(spark, sf_dir).select("label", F.posexplode("vec").alias("j", "x")).groupBy("label", "j").agg(F.round(F.sum(F.abs("x"))).alias("s"))
    p = f.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda e: e["s"]).alias("p"))
    d = p.withColumnRenamed("label", "a").join(p.withColumnsRenamed({"label": "b", "p": "q"}), F.col("a") < F.col("b"))
    return d.select("a", "b", F.round(special.multinomial_distance("p", "q"), 6).alias("distance"), F.round(special.multinomial_subspace_distance("p", "q"), 6).alias("subspace"))
