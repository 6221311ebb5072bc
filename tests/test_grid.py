"""Models over packed blocks of non-zeros: the same numbers however many blocks there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfold.operators import factor, grid, special


def matrix(spark, x):
    return spark.createDataFrame([(100 + 7 * i, 3 * j, int(n)) for i, row in enumerate(x) for j, n in enumerate(row) if n], "cell_id long, gene_id long, n long")


@pytest.fixture(scope="module")
def counts():
    x = np.random.default_rng(11).poisson(0.8, (30, 20))
    x[4] = 0
    return x


@pytest.fixture(params=[2_000_000, 30])
def blocks(request, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", request.param)
    monkeypatch.setattr(grid, "ROW", 16)


def test_a_step_sums_by_either_side(spark, counts, blocks):
    g = grid.Grid(matrix(spark, counts))
    assert (g.parts > 1) == (grid.BLOCK == 30) and len(set(g.names)) == g.parts**2
    cells, genes = g.start("cell_id", [F.col("cell_id")]), g.start("gene_id", [F.col("gene_id"), F.col("k")])
    got = g.step("cell_id", cells, genes, (1, 2), lambda i, j, n, a, b: [n * b[j, 0], n * a[i, 0] * b[j, 1]], lambda t, old: np.hstack([t, old]))
    there = (counts > 0).sum(0)
    want = {100 + 7 * i: [row @ (3.0 * np.arange(20)), (100 + 7 * i) * (row @ there), 100 + 7 * i] for i, row in enumerate(counts) if row.any()}
    assert {r.cell_id: r.v for r in g.rows("cell_id", got, 3).collect()} == want
    assert g.total(genes, 2).tolist() == [3.0 * np.arange(20)[there > 0].sum(), there.sum()]


def test_uniform_scaling_equals_dense_steps(spark, counts, blocks):
    n = len(counts)
    u, v = (dict(map(tuple, d.collect())) for d in special.uniform_scaling(matrix(spark, counts), n, rounds=3))
    x = counts[counts.any(1)].astype(float)
    want, a, b = -np.log(np.maximum(1e-9, 1 - (x > 0).sum(0) / n)), np.full(len(x), 0.5), np.full(20, 0.5)
    for _ in range(3):
        ratio = np.clip(want / np.maximum((x * a[:, None] * b).sum(0) / n, 1e-9), 0.25, 4)
        a, b = np.minimum(1, a * np.exp(0.25 * (x @ (b * np.log(ratio))) / (x @ b))), np.minimum(1, b * ratio**0.5)
    assert [u[k] for k in sorted(u)] == pytest.approx(a / a.mean()) and [v[k] for k in sorted(v)] == pytest.approx(b * a.mean())


def test_poisson_factors_do_not_depend_on_blocks(spark, counts, monkeypatch):
    """Before, each half round joined all non-zeros with both sides; now it joins none."""
    m, found = matrix(spark, counts), []
    for size in (2_000_000, 30):
        monkeypatch.setattr(grid, "BLOCK", size)
        found.append([{r[0]: r[1] for r in d.collect()} for d in factor.poisson_factors(m, 2, iterations=3)])
    for one, two in zip(*found, strict=True):
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_no_counts_no_rows(spark):
    m = spark.createDataFrame([], "cell_id long, gene_id long, n long")
    assert [d.count() for d in factor.poisson_factors(m, 2, iterations=2)] == [0, 0]
