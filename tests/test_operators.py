"""Hand-computed fixtures and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfold.functions.columns import clip, div0
from grainfold.operators import aggregate, cluster, doublets, enrich, factor, graph, qc, reports, residuals, select, windows

COUNTS = [[1, 0, 2, 0], [0, 0, 3, 1], [4, 0, 0, 0]]


def sparse(spark, dense):
    return spark.createDataFrame([(i, j, int(n), 0) for i, row in enumerate(dense) for j, n in enumerate(row) if n], "cell_id long, gene_id long, n long, u long")


def axis(spark, key, n, **more):
    d = spark.range(n).withColumnRenamed("id", key)
    for k, v in more.items():
        d = d.withColumn(k, v)
    return d


@pytest.fixture(scope="module")
def random_counts():
    return np.random.default_rng(0).poisson(0.7, (40, 25))


def test_div0_and_clip(spark):
    d = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (float("nan"), 1.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in d.select(div0(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, 2.0, 0.0]
    assert d.where("a = 6").select(clip(F.col("a"), 0, 5)).first()[0] == 5.0


def test_summaries(spark):
    m = sparse(spark, [*COUNTS, [0] * 4])
    genes = axis(spark, "gene_id", 4, is_mt=F.col("gene_id") == 0, is_cc=F.col("gene_id") == 2)
    cells = {r.cell_id: r for r in qc.cell_summary(m, axis(spark, "cell_id", 4), genes).collect()}
    assert (cells[0].n_genes, cells[0].total_umis, cells[3].total_umis, cells[3].mito_fraction) == (2, 3, 0, None)
    assert cells[0].mito_fraction == pytest.approx(1 / 3) and cells[1].cell_cycle_fraction == 0.75
    per = {r.gene_id: r for r in qc.gene_summary(m, genes, 4).collect()}
    x = np.array([*COUNTS, [0] * 4])
    for j in range(4):
        assert per[j].mean == pytest.approx(x[:, j].mean()) and per[j].sd == pytest.approx(x[:, j].std()) and per[j].nonzeros == (x[:, j] > 0).sum()
    assert not per[1].valid


def dense_residuals(x, low):
    mu = np.outer(x.sum(1), x.sum(0)) / x.sum()
    with np.errstate(all="ignore"):
        r = np.nan_to_num((x - mu) / np.sqrt(mu + mu**2 / 100))
    b = math.sqrt(len(x))
    return np.clip(r, -b if low else 0, b)


def test_sparse_residuals_equal_dense(spark, random_counts):
    m, genes = sparse(spark, random_counts), axis(spark, "gene_id", 25)
    want = dense_residuals(random_counts, False).var(0)
    got = {r.gene_id: r.variance for r in residuals.residual_variance(m, genes, 40).collect()}
    assert [got[j] for j in range(25)] == pytest.approx(want.tolist())
    both = dense_residuals(random_counts, True)
    for r in residuals.pearson(m, 40).collect():
        assert r.residual == pytest.approx(both[r.cell_id, r.gene_id])


def test_one_batch_is_rescaled_to_a_common_mean(spark, random_counts):
    m, genes = sparse(spark, random_counts), axis(spark, "gene_id", 25)
    got = {r.gene_id: r.variance for r in residuals.batch_residuals(m, axis(spark, "cell_id", 40, batch=F.lit("a")), genes, 40).collect()}
    r = dense_residuals(random_counts, False)
    means = r.mean(0)
    want = (r * np.where(means > 0, means.mean() / np.maximum(means, 1e-300), 0)).var(0)
    assert [got[j] for j in range(25)] == pytest.approx(want.tolist())


def test_sparse_deviance_equals_dense(spark, random_counts):
    x = random_counts.astype(float)
    n, p = x.sum(1, keepdims=True), (x.sum(0) / x.sum())[None]
    with np.errstate(all="ignore"):
        want = 2 * (np.nan_to_num(x * np.log(x / (n * p))) + np.nan_to_num((n - x) * np.log((n - x) / (n * (1 - p))))).sum(0)
    got = {r.gene_id: r.deviance for r in residuals.deviance(sparse(spark, random_counts), axis(spark, "gene_id", 25)).collect()}
    assert [got[j] for j in range(25)] == pytest.approx(want.tolist())


def test_trinarize_known_values(spark):
    keys = [(0, 5, 0.357460679), (3, 10, 0.855575765), (20, 60, 0.994479236)]
    d = spark.createDataFrame([(0, i, k, n) for i, (k, n, _) in enumerate(keys)], "group_id long, gene_id long, nnz long, count long")
    got = {r.gene_id: r.probability for r in enrich.trinarize(d).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([p for *_, p in keys], abs=1e-8)
    big = spark.createDataFrame([(0, k, 200 * k, 4000) for k in range(5)], "group_id long, gene_id long, nnz long, count long")
    p = [r.probability for r in enrich.trinarize(big).orderBy("gene_id").collect()]
    assert p == sorted(p) and p[0] < 1e-12 and p[4] > 0.4


def test_equal_groups_are_not_enriched(spark):
    m = sparse(spark, [[2, 0, 1], [1, 1, 0], [2, 0, 1], [1, 1, 0]])
    groups = axis(spark, "cell_id", 4, group_id=F.floor(F.col("cell_id") / 2))
    got = enrich.enrichment_by(m, groups, axis(spark, "gene_id", 3)).collect()
    assert len(got) == 6 and all(r.enrichment == pytest.approx(1) for r in got)


def test_aggregate_rejects_unknown_functions(spark):
    with pytest.raises(ValueError):
        aggregate.aggregate_vector(spark.range(2), "id", {"x": ("id", "mode")})
    with pytest.raises(ValueError):
        aggregate.aggregate_matrix(spark.range(2), spark.range(2), spark.range(2), ["first"])


def test_forward_mean(spark):
    d = spark.createDataFrame([("a", i, float(i + 1)) for i in range(5)] + [("b", 0, 2.0), ("b", 1, 4.0)], "k string, i int, x double")
    got = {(r.k, r.i): r.smoothed for r in windows.forward_mean(d, ["k"], "i", "x", 3).collect()}
    assert [got["a", i] for i in range(5)] == [2, 3, 4, 4, 4] and [got["b", i] for i in range(2)] == [3, 3]


def brute_centred(x, n, f):
    out = []
    for c in range(len(x)):
        nn = min(n, len(x))
        a, b = c - n // 2, c + n // 2
        if a < 0:
            a, b = 0, nn
        elif b > len(x):
            a, b = len(x) - nn, len(x)
        out.append(f(x[a:b]))
    return out


@pytest.mark.parametrize("how", ["mean", "median"])
@pytest.mark.parametrize("n", [4, 5, 50])
def test_centred(spark, how, n):
    x = np.random.default_rng(n).random(20)
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, i int, x double")
    got = [r.smoothed for r in windows.centred(d, ["k"], "i", "x", n, how).orderBy("i").collect()]
    assert got == pytest.approx(brute_centred(x, n, np.mean if how == "mean" else np.median))


def test_knn_and_mutual_graph(spark):
    d = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 1, 3, 7])], "cell_id long, vec array<double>")
    got = {(r.src, r["rank"]): (r.dst, r.dist) for r in graph.knn(d, 2, block=2).collect()}
    assert got[0, 1] == (1, 1.0) and got[3, 1] == (2, 4.0) and got[2, 2] == (0, 3.0)
    e = graph.knn(d, 1).select("src", "dst", F.lit(1.0).alias("weight"))
    assert {(r.src, r.dst) for r in graph.mutual(e).collect()} == {(0, 1), (1, 0)}
    assert all(r.s == pytest.approx(1) for r in graph.row_weights(graph.knn(d, 2)).groupBy("src").agg(F.sum("weight").alias("s")).collect())
    r = graph.radius_graph(graph.knn(d, 2), 0.5)
    assert 0 < r.count() < 8


def test_knn_over_blocks_equals_brute_force(spark):
    x = np.random.default_rng(3).random((60, 5))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    got = {(r.src, r["rank"]): r.dst for r in graph.knn(d, 6, block=13).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    assert got == {(i, r + 1): int(j) for i in range(60) for r, j in enumerate(np.argsort(dist[i])[:6])}


def test_balance_bounds_degrees(spark):
    x = np.random.default_rng(2).random((30, 3))
    x[0] = x.mean(0)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    got = graph.balance(graph.knn(d, 10), 3, 4)
    assert got.groupBy("src").count().agg(F.max("count")).first()[0] <= 3 and got.groupBy("dst").count().agg(F.max("count")).first()[0] <= 4
    assert got.count() >= 60


def test_communities_find_planted_blocks(spark):
    r = np.random.default_rng(0)
    edges = [(i, j, 1.0) for i in range(60) for j in range(60) if i != j and r.random() < (0.4 if i // 20 == j // 20 else 0.02)]
    e = spark.createDataFrame(edges + [(j, i, w) for i, j, w in edges], "src long, dst long, weight double")
    labels = cluster.communities(e)
    of = {r.cell_id: r.label for r in labels.collect()}
    assert len({of[i] for i in range(60)}) <= 6 and cluster.modularity(e, labels) > 0.5


def test_polish(spark):
    labels = spark.createDataFrame([(i, 7) for i in range(5)] + [(5, 9), (6, 9), (7, 3)], "cell_id long, label long")
    near = spark.createDataFrame([(5, 6, 0.1), (5, 0, 0.2), (6, 1, 0.3)], "src long, dst long, dist double")
    got = {r.cell_id: r.label for r in cluster.polish(labels, near, 3).collect()}
    assert got == {**{i: 0 for i in range(7)}, 7: -1}


def test_ward_and_cut():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    t = cluster.ward(x)
    assert t[0][:2] == (0, 1) and t[-1][3] == 5 and [s for *_, s in t] == [2, 2, 4, 5]
    assert t[0][2] == pytest.approx(0.1) and [d for _, _, d, _ in t] == sorted(d for _, _, d, _ in t)
    assert sorted(cluster.leaves(t)) == [0, 1, 2, 3, 4]
    three = cluster.cut(t, 3)
    assert three[0] == three[1] and three[2] == three[3] and len(set(three)) == 3
    assert cluster.subtrees({i: 10 for i in range(5)}, list(range(5)), t, 3, min_cells=15) == dict(enumerate(cluster.cut(t, 1)))
    assert cluster.cut([], 2) == [0]


def test_viterbi_follows_steps(spark):
    x = [2.0] * 15 + [3.1] * 15 + [2.05] * 10 + [1.0] * 15
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "k int, i int, x double")
    got = [r.state for r in cluster.viterbi(d, ["k"], "i", "x").orderBy("i").collect()]
    assert got == [2] * 15 + [3] * 15 + [2] * 10 + [1] * 15


def test_principal_components_equal_svd(spark):
    x = np.random.default_rng(0).random((50, 6)) * [5, 1, 1, 0.5, 0.5, 0.1]
    m = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "cell_id long, gene_id long, value double")
    chosen = spark.createDataFrame([(j, j + 1) for j in range(6)], "gene_id long, rank int")
    scores, share = factor.principal_components(factor.cell_vectors(m, chosen, axis(spark, "cell_id", 50)), 4)
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False) ** 2
    assert share == pytest.approx((s / s.sum())[:4].tolist())
    f = np.array([r.factors for r in scores.orderBy("cell_id").collect()])
    assert np.abs(f.mean(0)).max() < 1e-9 and f.shape[1] == 1
    assert (f[:, 0] ** 2).sum() == pytest.approx(s[0])


def test_poisson_factors_split_blocks(spark):
    r = np.random.default_rng(1)
    x = np.zeros((30, 20), int)
    x[:15, :10] = r.poisson(4, (15, 10))
    x[15:, 10:] = r.poisson(4, (15, 10))
    theta, _ = factor.poisson_factors(sparse(spark, x), 2, iterations=8)
    side = {r.cell_id: int(np.argmax(r.theta)) for r in theta.collect()}
    assert len({side[i] for i in range(15)}) == 1 and side[0] != side[29]


def test_harmonise_removes_a_shift(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((80, 4)) * 0.1 + np.where(np.arange(80)[:, None] % 2 == 0, [[3, 0, 0, 0]], [[0, 3, 0, 0]])
    b = np.arange(80) // 40
    x[b == 1] += [0, 0, 1.0, 0]
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    batches = spark.createDataFrame([(i, str(k)) for i, k in enumerate(b)], "cell_id long, batch string")
    got = np.array([r.vec for r in factor.harmonise(f, batches, clusters=2, rounds=3).orderBy("cell_id").collect()])
    assert abs(got[b == 0].mean(0) - got[b == 1].mean(0)).max() < 0.2
    assert factor.harmonise(f, batches.withColumn("batch", F.lit("x"))) is f


def test_bisection_splits_blocks(spark):
    r = np.random.default_rng(1)
    x = np.zeros((30, 20), int)
    x[:15, :11] = r.poisson(3, (15, 11))
    x[15:, 9:] = r.poisson(3, (15, 11))
    m = sparse(spark, x).select("cell_id", "gene_id", F.col("n").cast("double").alias("value"))
    side = {r.cell_id: r.side for r in cluster.bisect(m, 12).collect()}
    assert len({side[i] for i in range(15)}) == 1 and side[0] != side[29]


def test_simulated_doublets_are_sums_of_pairs(spark, random_counts):
    m = sparse(spark, random_counts)
    d = doublets.simulate(m, axis(spark, "cell_id", 40), 0.2)
    assert d.select("cell_id").distinct().count() <= 10 and d.agg(F.max("cell_id")).first()[0] < 0


def test_cell_hashes(spark):
    import hashlib

    got = {r.cell_id: int(r.hash) for r in doublets.cell_hashes(sparse(spark, COUNTS), axis(spark, "cell_id", 4), axis(spark, "gene_id", 4)).collect()}
    for i, row in enumerate([*COUNTS, [0] * 4]):
        assert got[i] == int.from_bytes(hashlib.sha1(np.array(row, "<u2").tobytes()).digest()[:8], "little")


def test_rank_sum(spark):
    d = spark.createDataFrame([(1, 3.0), (1, 2.0), (0, 1.0), (0, 2.0), (0, 0.5)], "g int, x double")
    r = reports.rank_sum(d, "g", "x").first()
    assert (r.n0, r.n1, r.u) == (3, 2, 5.5)


def test_select_is_greedy_and_distinct(spark):
    t = spark.createDataFrame([(g, k, float(10 - k if g == 0 else 9 - k)) for g in range(2) for k in range(6)], "group_id long, gene_id long, enrichment double")
    assert select.by_multilevel_enrichment([t, t], [2, 1]) == [(0, 0, 0), (0, 0, 1), (0, 1, 2), (0, 1, 3), (1, 0, 4), (1, 1, 5)]


def test_upper_gamma_and_glm_factors(spark):
    from grainfold.operators import glmpca, special

    # Q(n, x) of a whole n is a Poisson sum
    for n in (1, 3, 20, 150):
        for x in (0.0, 0.5, 2.0, 19.0, 140.0, 400.0):
            want = sum(math.exp(-x + j * math.log(x) - math.lgamma(j + 1)) for j in range(n)) if x else 1.0
            assert special.upper_gamma(np.array([n]), np.array([x]))[0] == pytest.approx(want, abs=1e-10)
    r = np.random.default_rng(1)
    x = np.zeros((30, 12), int)
    x[:15] = r.poisson([6] * 6 + [1] * 6, (15, 12))
    x[15:] = r.poisson([1] * 6 + [6] * 6, (15, 12))
    f, _, history = glmpca.poisson_glm_factors(sparse(spark, x), 2, rounds=12)
    first = np.array([row.factors[0] for row in f.orderBy("cell_id").collect()])
    assert history[-1] < 0.8 * history[0]
    assert (np.sign(first[:15] - np.median(first)) == np.sign(first[0] - np.median(first))).mean() > 0.9


def test_uniform_scaling_nears_its_target(spark, random_counts):
    from grainfold.operators import special

    m = sparse(spark, random_counts * 3)
    u, v = special.uniform_scaling(m, 40, rounds=15)
    got = m.drop("u").join(u, "cell_id").join(v, "gene_id").groupBy("gene_id").agg((F.sum(F.col("n") * F.col("u") * F.col("v")) / 40).alias("got"), F.count("*").alias("k"))
    for r in got.collect():
        if r.k < 36:
            assert r.got == pytest.approx(-math.log(1 - r.k / 40), rel=0.3)


def test_embedding_optimises_every_cell(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((200, 8)) + np.repeat(r.standard_normal((4, 8)) * 6, 50, axis=0)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    got = np.array([(row.x, row.y) for row in doublets.embed(d, sample=40, iterations=120, perplexity=10).orderBy("cell_id").collect()])
    assert got.shape == (200, 2) and len(np.unique(got.round(6), axis=0)) == 200

    def nearest(v):
        dist = ((v[:, None] - v[None]) ** 2).sum(2)
        np.fill_diagonal(dist, np.inf)
        return np.argsort(dist, axis=1)[:, :10]

    kept = [len(set(a) & set(b)) / 10 for a, b in zip(nearest(x), nearest(got), strict=True)]
    assert np.mean(kept) > 0.4 and (np.repeat(np.arange(4), 50)[nearest(got)[:, 0]] == np.repeat(np.arange(4), 50)).mean() > 0.95


def test_models_are_registered_whole(spark, monkeypatch, sf_dir):
    from grainfold import catalog_models
    from grainfold.operators import glmpca, special

    seen = {}
    for part, name in ((factor, "topics"), (factor, "poisson_factors"), (factor, "harmonise"), (cluster, "bisect"), (glmpca, "poisson_glm_factors"), (special, "uniform_scaling")):
        monkeypatch.setattr(part, name, lambda *a, _n=name, **k: seen.setdefault(_n, k) and None or (None, None))
    for q in ("topic_model", "poisson_factors", "batch_corrected", "bisection", "poisson_glm_factors", "uniform_scaling"):
        getattr(catalog_models, q)(spark, sf_dir)
    assert len(seen) == 6 and not {k for kw in seen.values() for k in kw} & {"iterations", "rounds", "vocabulary", "clusters"}


def test_glm_factors_stop_on_a_tolerance(spark, random_counts):
    from grainfold.operators import glmpca

    _, _, history = glmpca.poisson_glm_factors(sparse(spark, random_counts), 1, tolerance=0.02)
    assert 1 < len(history) < 200 and abs(history[-1] - history[-2]) <= 0.02 * abs(history[-2])


def test_approximate_neighbours(spark):
    from grainfold.operators import graph

    r = np.random.default_rng(2)
    x = r.standard_normal((900, 12)) + 3 * r.standard_normal((9, 12))[r.integers(0, 9, 900)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    exact = {(e.src, e.dst) for e in graph.knn(d, 10).collect()}
    near = graph.knn_approximate(d, 10, block=120).collect()
    assert len(near) == 9000 and all(e.src != e.dst and 1 <= e["rank"] <= 10 for e in near)
    assert len(exact & {(e.src, e.dst) for e in near}) > 0.9 * len(exact)
    for e in near[:50]:
        assert abs(e.dist - np.linalg.norm(x[e.src] - x[e.dst])) < 1e-6
    one = {(e.src, e.dst) for e in graph.knn_approximate(d.limit(60), 3).collect()}
    assert one == {(e.src, e.dst) for e in graph.knn(d.limit(60), 3).collect()}
    assert graph.knn_approximate(d.where("false"), 3).count() == 0 and graph.knn_approximate(d.limit(1), 3).count() == 0


def test_positions(spark):
    from grainfold.operators import windows

    r = np.random.default_rng(1)
    values = r.integers(0, 40, 500).tolist()
    d = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(values)], "k long, v long, w long")
    got = windows.positions(d, ["v", "k"], "at").collect()
    order = sorted(range(500), key=lambda i: (values[i], i))
    assert {r.k: r.at for r in got} == {i: n for n, i in enumerate(order)}
    weighed = {r.k: r.at for r in windows.positions(d, ["v", "k"], "at", "w").collect()}
    total = 0
    for i in order:
        assert weighed[i] == total
        total += i % 3
    assert windows.positions(d.where("false"), ["v"], "at").count() == 0


def line_at(x, y, i, k, trust):
    """The local line at x[i], step by step: the k nearest in a window that moves while the next point is nearer than the first."""
    a = 0
    for j in range(i + 1):
        while a + k < len(x) and x[a + k] - x[j] < x[j] - x[a]:
            a += 1
    near = range(a, a + k)
    h = max(abs(x[j] - x[i]) for j in near)
    w = {j: (0.0 if abs(x[j] - x[i]) > 0.999 * h else 1.0 if abs(x[j] - x[i]) <= 0.001 * h else (1 - (abs(x[j] - x[i]) / h) ** 3) ** 3) * trust[j] for j in near}
    used = [j for j in near if w[j] > 0]
    slope, level = np.polyfit([x[j] - x[i] for j in used], [y[j] for j in used], 1, w=[math.sqrt(w[j]) for j in used])
    return level


def test_lowess(spark):
    r = np.random.default_rng(3)
    x = np.cumsum(r.integers(1, 9, 40)).astype(float)
    y = np.sin(x / 20) + r.normal(0, 0.1, 40)
    y[17] += 5
    want, trust = None, np.ones(40)
    for turn in range(4):
        want = np.array([line_at(x, y, i, 12, trust) for i in range(40)])
        off = np.abs(y - want)
        u = off / (6 * np.median(off))
        trust = np.where(u >= 0.999, 0.0, np.where(u <= 0.001, 1.0, (1 - u**2) ** 2))
    d = spark.createDataFrame([("a", float(p), float(v)) for p, v in zip(x, y)] + [("b", 1.0, 7.0), ("b", 2.0, 9.0)], "k string, x double, y double")
    got = {(p.k, p.x): p.smoothed for p in windows.lowess(d, ["k"], "x", "y", 12).collect()}
    assert [got["a", p] for p in x] == pytest.approx(list(want), abs=1e-8)
    assert (got["b", 1.0], got["b", 2.0]) == (7.0, 9.0)
    assert abs(got["a", x[17]]) < 1.5  # the outlier has no say
    assert windows.local_lines(np.ones(6), np.arange(6.0), 0.5, 0)[0] == pytest.approx(1.0)


def test_gene_set_p(spark):
    groups = spark.createDataFrame([(0, g, 10.0 if g < 4 else 1.0) for g in range(40)] + [(1, g, 1.0) for g in range(40)], "group_id long, gene_id long, enrichment double")
    members = spark.createDataFrame([("top", g) for g in range(4)] + [("rest", g) for g in range(30, 34)], "set_name string, gene_id long")
    p = {(r.group_id, r.set_name): r for r in enrich.gene_set_p(groups, members, permutations=200).collect()}
    scores = {(r.group_id, r.set_name): r.score for r in enrich.gene_set_score(groups, members).collect()}
    assert {k: r.score for k, r in p.items()} == pytest.approx(scores)
    assert p[0, "top"].p <= 0.02 and p[0, "rest"].p > 0.5
    e, sets = np.array([2.0, 1.0, 0.0]), np.array([[True, False, True], [False, False, False], [True, True, True]])
    assert enrich.running_scores(e, sets).tolist() == pytest.approx([1.0, -1 / 3, 1.0])


def test_classify_small_clusters(spark):
    r = np.random.default_rng(0)
    at = np.array([[0, 0], [8, 0], [0, 8]])
    rows = [(i, [float(v) for v in at[i % 2] + r.normal(0, 1, 2)], 50 + i % 2) for i in range(60)]
    rows += [(100 + i, [float(v) for v in at[i % 2] + r.normal(0, 1, 2)], 7) for i in range(4)]
    d = spark.createDataFrame(rows, "cell_id long, vec array<double>, label long")
    got = {x.cell_id: x for x in cluster.classify(d.select("cell_id", "label"), d.select("cell_id", "vec"), 10).collect()}
    assert len(got) == 64 and {x.label for x in got.values()} == {0, 1}
    assert all(got[i].label == i % 2 == got[100 + i % 4].label for i in range(4)) and all(got[i].label == i % 2 for i in range(60))
    assert all(x.probability >= x.secondary_probability and x.probability + x.secondary_probability == pytest.approx(1) and x.secondary is not None for x in got.values())
    alone = cluster.classify(d.select("cell_id", "label"), d.select("cell_id", "vec"), 1000).collect()
    assert {(x.label, x.secondary, x.probability) for x in alone} == {(-1, None, None)}


def test_one_hot_and_thresholds(spark):
    d = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "cell_id long, k string")
    assert {r.cell_id: r.one_hot for r in aggregate.one_hot(d, "k").collect()} == {1: [0, 1], 2: [1, 0], 3: [0, 0]}
    assert [r.one_hot for r in aggregate.one_hot(d.where("k = 'a'"), "k").collect()] == [[]]
    scores = spark.createDataFrame([(1, "s", 2.0), (2, "s", 0.5)], "cell_id long, set_name string, score double")
    over = spark.createDataFrame([(1, 1.0), (2, 1.0)], "cell_id long, threshold double")
    assert [r.cell_id for r in reports.capped_scores(scores, bootstrap=over).collect()] == [1]


def test_balance_is_the_greedy_rule_to_the_end(spark):
    r = np.random.default_rng(5)
    rows = [(i, int(j), float(r.integers(1, 9))) for i in range(30) for j in r.permutation(30)[:18] if i != j]
    for k, most in ((1, 2), (4, 3)):
        left, have, used, want = sorted((s, d, t) for s, t, d in rows), {}, {}, set()
        while offers := {s: (d, s, t) for s, d, t in reversed(left) if have.get(s, 0) < k}:
            for d, s, t in sorted(offers.values()):
                if used.get(t, 0) < most:
                    want.add((s, t, d))
                    used[t], have[s] = used.get(t, 0) + 1, have.get(s, 0) + 1
            left = [e for e in left if e[0] not in offers or (offers[e[0]][2] != e[2])]
        got = graph.balance(spark.createDataFrame(rows, "src long, dst long, dist double"), k, most)
        assert {tuple(e) for e in got.select("src", "dst", "dist").collect()} == want
    none = spark.createDataFrame([], "src long, dst long, dist double")
    assert graph.balance(none, 2, 2).count() == 0


def test_approximate_neighbours_that_meet_in_part(spark, monkeypatch):
    r = np.random.default_rng(12)
    x = r.standard_normal((900, 12)) + 3 * r.standard_normal((9, 12))[r.integers(0, 9, 900)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    exact = {(e.src, e.dst) for e in graph.knn(d, 20).collect()}
    monkeypatch.setattr(graph, "MET", 8)
    near = graph.knn_approximate(d, 20, block=120).collect()
    assert len(near) == len({(e.src, e.dst) for e in near}) == 18000 and all(e.src != e.dst for e in near)
    assert len(exact & {(e.src, e.dst) for e in near}) > 0.9 * len(exact)
    same = spark.createDataFrame([(i, [float(i >= 500), 1 / 3]) for i in range(510)], "cell_id long, vec array<double>")
    got = graph.knn_approximate(same, 4, block=50).collect()
    assert len(got) == 2040 and all(e.dist == 0 and (e.src >= 500) == (e.dst >= 500) for e in got)


def test_topics_take_sparse_vectors(spark, monkeypatch):
    """Before, every document went to the model as a dense vector of the vocabulary."""
    from pyspark.ml.linalg import SparseVector

    seen = []
    model = factor.LDA
    monkeypatch.setattr(factor, "LDA", lambda **kw: type("Model", (), {"fit": lambda _, v: seen.extend(v.collect()) or model(**kw).fit(v)})())
    counts = spark.createDataFrame([(0, "a", 2), (0, "c", 1), (1, "b", 3), (2, "a", 1)], "cell_id long, token string, n long")
    assert factor.topics(counts, 2, iterations=2)[0].count() == 3
    assert all(isinstance(r.vector, SparseVector) for r in seen)
    assert {r.cell_id: r.vector.toArray().tolist() for r in seen} == {0: [2, 0, 1], 1: [0, 3, 0], 2: [1, 0, 0]}
