"""Doublet scores against a dense version of the whole method, and the modes of scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfold.operators import doublets, modes, select


def scores(*parts):
    s, n = np.unique(np.round(np.clip(np.concatenate(parts), 0, 1), 2), return_counts=True)
    return s, n.astype(float)


def test_modes_of_scores():
    r = np.random.default_rng(0)
    for part in (r.normal(0.4, 0.1, 3000), r.uniform(0, 1, 3000), r.beta(1, 5, 4000), np.full(500, 0.3)):
        assert modes.upper_cluster(*scores(part)) == 1.0
    s, n = scores(r.normal(0.15, 0.07, 1500), r.normal(0.85, 0.07, 1500))
    assert len(modes.intervals(modes.cumulated(s, n), n.sum())) > 1 and 0.5 < modes.upper_cluster(s, n) < 0.7
    assert modes.two_means(np.array([0.0, 0.1, 0.2, 0.7, 0.9]), np.array([5.0, 1, 5, 2, 1])) == 3
    assert modes.upper_cluster(np.zeros(0), np.zeros(0)) == 1.0


def test_dip_of_a_distribution():
    # half of the values near either end: the nearest unimodal distribution is a quarter off
    f = np.r_[np.linspace(0, 0.5, 11), np.full(979, 0.5), np.linspace(0.5, 1, 11)[1:]]
    assert modes.dip(f)[0] == pytest.approx(0.25, abs=0.01)
    assert modes.dip(np.linspace(0, 1, 500))[0] == pytest.approx(0, abs=1e-12)
    assert modes.dip(np.linspace(0, 1, 500) ** 3)[0] == pytest.approx(0, abs=1e-12)


def dense(x, made, k, threshold):
    """Scores and classes of the method on dense counts, cells in rows; all genes and all components."""
    every, n = np.concatenate([x, made]).astype(float), len(x)
    v = np.log1p(every / every.sum(1, keepdims=True) * 1e5)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    real = np.sort(d[n:, :n], axis=1)[:, :10]
    bound = real.mean() + 1.64 * real.std()
    hit = (near >= n) & (np.take_along_axis(d, near, 1) < bound)
    score = np.maximum(hit.mean(1), hit[:, : -(-k // 2)].mean(1))
    cut = threshold
    if cut is None:
        top = min(1.0, np.round(np.percentile(score[:n], 100 - 5e-4 * n), 3))
        low = min(1.0, modes.upper_cluster(*np.unique(score[n:], return_counts=True)))
        cut = top if (score[:n] >= low).sum() > (score[:n] >= top).sum() else low
    one = score[:n] >= cut
    kind = one.astype(int)
    if one.any():
        d = d[:n, :n]
        mine = np.argsort(d, axis=1, kind="stable")[:, :k]
        ten = np.sort(d[one], axis=1)[:, :10]
        close = np.take_along_axis(d, mine, 1) < ten.mean() + 1.64 * ten.std()
        share = (close & one[mine]).sum(1) / close.sum(1)
        kind[~one & (share >= cut / 2)] = 2
    return score[:n], kind, cut


@pytest.mark.parametrize("threshold", [None, 0.3])
def test_doublets_equal_a_dense_version(spark, monkeypatch, threshold):
    r = np.random.default_rng(8)
    n, genes = 120, 12
    rate = np.where(np.arange(genes)[None] // 6 == r.integers(0, 2, n)[:, None], 30.0, 1.0)
    mixed = np.arange(n) % 10 == 0
    x = r.poisson(np.where(mixed[:, None], 31.0, rate)) + 1
    m = spark.createDataFrame([(i, j, int(c), 0) for i, row in enumerate(x) for j, c in enumerate(row)], "cell_id long, gene_id long, n long, u long")
    cells, axis = spark.range(n).withColumnRenamed("id", "cell_id"), spark.range(genes).withColumnRenamed("id", "gene_id")
    monkeypatch.setattr(select, "by_dispersion", lambda s, k: s.select("gene_id", (F.col("gene_id") + 1).cast("int").alias("rank")))
    made = np.zeros((n, genes), int)
    for e in doublets.simulate(m, cells, 0.3).collect():
        made[-e.cell_id, e.gene_id] = e.n
    made = made[made.sum(1) > 0]
    got = {e.cell_id: e for e in doublets.doublet_scores(m, cells, axis, share=0.3, k=12, threshold=threshold).collect()}
    score, kind, cut = dense(x, made, 12, threshold)
    assert [got[i].doublet_score for i in range(n)] == pytest.approx(score.tolist())
    assert [got[i].doublet_class for i in range(n)] == kind.tolist()
    assert threshold is None or {1, 2} <= set(kind) and kind[mixed].all()


def test_the_upper_mode_sets_the_threshold(spark, monkeypatch):
    """Before, only the percentile of the real scores did."""
    asked = []
    monkeypatch.setattr(modes, "upper_cluster", lambda s, n: asked.append(n.sum()) or 0.0)
    m = spark.createDataFrame([(i, j, int(c), 0) for i, row in enumerate(1 + np.random.default_rng(9).poisson(3, (40, 6))) for j, c in enumerate(row)], "cell_id long, gene_id long, n long, u long")
    cells, axis = spark.range(40).withColumnRenamed("id", "cell_id"), spark.range(6).withColumnRenamed("id", "gene_id")
    monkeypatch.setattr(select, "by_dispersion", lambda s, k: s.select("gene_id", (F.col("gene_id") + 1).cast("int").alias("rank")))
    rows = doublets.doublet_scores(m, cells, axis, k=4).collect()
    # 0 would take all cells: the stricter of the two holds
    assert asked == [10] and 0 < sum(r.doublet_class == 1 for r in rows) < 40
