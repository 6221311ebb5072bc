import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfold.operators import umap


def test_curve_and_bandwidths():
    a, b = umap.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)
    r = np.random.default_rng(0)
    d = np.sort(r.random((50, 15)) * r.random((50, 1)) * 9, axis=1)
    d[3, 10:] = np.inf
    least, width = umap.bandwidths(d)
    assert np.allclose(least, d[:, 0])
    total = np.exp(-np.maximum(d - least[:, None], 0) / width[:, None]).sum(1)
    assert np.allclose(np.delete(total, 3), np.log2(15), atol=1e-6) and total[3] == pytest.approx(np.log2(10), abs=1e-6)
    assert np.isfinite(umap.bandwidths(np.array([[0.0, 0.0], [np.inf, np.inf]]))[1]).all()


def test_union_of_directions(spark):
    near = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 1, 1.0), (2, 3, 4.0), (3, 1, 2.0), (3, 2, 4.0)], "src long, dst long, dist double")
    got = {(r.src, r.dst): r.weight for r in umap.fuzzy_graph(near).collect()}
    assert len(got) == 6 and all(got[a, b] == pytest.approx(got[b, a]) and 0 < got[a, b] <= 1 for a, b in got)
    least, width = umap.bandwidths(np.array([[1.0, 2.0], [1.0, 4.0], [2.0, 4.0]]))
    w = np.exp(-(np.array([4.0, 4.0]) - least[1:]) / width[1:])
    assert got[2, 3] == pytest.approx(w[0] + w[1] - w[0] * w[1])


def kept(vectors, places, k=15):
    def near(x):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1)[:, :k]

    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(vectors), near(places), strict=True)])


@pytest.mark.parametrize("parts", [1, 3])
def test_neighbours_are_preserved(spark, monkeypatch, parts):
    """Four clouds on curved sheets of 20 dimensions, in one part of the cells and in several."""
    r = np.random.default_rng(7)
    n = 240
    t = r.random((n, 2))
    cloud = np.arange(n) % 4
    x = np.stack([np.cos(3 * t[:, 0]), np.sin(3 * t[:, 0]), t[:, 1]], 1) @ r.standard_normal((3, 20)) + 3 * r.standard_normal((4, 20))[cloud] + 0.01 * r.standard_normal((n, 20))
    monkeypatch.setattr(umap, "PART", -(-n // parts))
    monkeypatch.setattr(umap, "DRAWN", 150)
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    got = umap.umap(factors, rounds=12).orderBy("cell_id").toPandas()
    assert got["cell_id"].tolist() == list(range(n)) and np.isfinite(got[["x", "y"]].to_numpy()).all()
    assert kept(x, got[["x", "y"]].to_numpy()) > 0.45
    if parts == 1:
        assert umap.umap(factors.limit(0)).count() == 0
        assert [(v.x, v.y) for v in umap.umap(factors.where(F.col("cell_id") == 3)).collect()] == [(0.0, 0.0)]


def test_pull_and_alignment(spark):
    places = spark.createDataFrame([(1, 0.3, 0.4), (2, 0.0, -2.0), (3, 0.0, 0.0)], "cell_id long, x double, y double")
    levels = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 7.0)], "cell_id long, level double")
    got = {r.cell_id: (r.x, r.y) for r in umap.pull_towards_levels(places, levels, force=F.lit(0.5)).collect()}
    assert got[1] == pytest.approx((0.15, 0.2)) and got[2] == pytest.approx((0.0, -1.25)) and got[3] == (0.0, 0.0)
    by_hash = {r.cell_id: np.hypot(r.x, r.y) for r in umap.pull_towards_levels(places, levels).collect()}
    assert 0.5 * 0.05 <= by_hash[1] <= 0.5 * 0.4 and by_hash[3] == 0
    for bad in ([(1, 5.0), (2, 9.0)], [(1, 5.0), (2, 9.0), (3, 7.0), (4, 1.0)], [(1, 5.0), (2, 9.0), (3, 7.0), (3, 7.0)]):
        with pytest.raises(ValueError, match="align"):
            umap.pull_towards_levels(places, spark.createDataFrame(bad, "cell_id long, level double"))
