"""Larger tables: trees, components and factors where no gene is valid; distances of groups without their genes on the driver."""

import numpy as np

import pytest

from grainfold import catalog_matrix, catalog_models
from grainfold.operators import cluster, doublets, factor, glmpca, reports


def test_sides_without_genes_on_the_driver(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(5, 300)).round(3)
    x[3:] += 1
    copies = spark.createDataFrame([(g, i, float(x[g, i]), 2) for g in range(5) for i in range(300)], "group_id long, gene_id long, ploidy double, state int")
    seen, collect = [], type(copies).collect

    def watch(self):
        rows = collect(self)
        seen.append(sum(len(v) if isinstance(v, list) else 1 for r in rows for v in r))
        return rows

    monkeypatch.setattr(type(copies), "collect", watch)
    out = reports.ploidy_sides(copies)
    assert max(seen) <= 3 * 25  # pairs of groups, whatever the number of genes
    monkeypatch.undo()
    want = cluster.cut(cluster.ward(x), 2)
    rows = out.collect()
    assert len(rows) == 1500
    assert {(r.group_id, r.side) for r in rows} == set(enumerate(want))


def _groups(spark, n_groups=5):
    """Groups of three genes of which none is selected."""
    rows = [(g, i, float(g + i)) for g in range(n_groups) for i in range(3)]
    return spark.createDataFrame(rows, "group_id long, gene_id long, mean double"), spark.createDataFrame([], "gene_id long, rank int")


def test_tree_without_genes_has_every_group(spark):
    ids, linkage = cluster.dendrogram(*_groups(spark))
    assert ids == list(range(5)) and sorted(cluster.leaves(linkage)) == ids and len(linkage) == 4
    assert linkage[0][2] == 1.0
    of = cluster.subtrees(dict.fromkeys(ids, 10), ids, linkage, 3, min_cells=10)
    assert set(of) == set(ids) and len(set(of.values())) == 3


def test_no_groups_have_no_subtrees(spark):
    groups, none = _groups(spark, 0)
    assert cluster.dendrogram(groups, none) == ([], [])
    assert cluster.subtrees({}, [], [], 4) == {}


def _sparse(spark, monkeypatch):
    """The queries' input: 3,000 cells in three clusters, three genes of three cells each, so none is valid."""
    m = spark.createDataFrame([(100 * g + i, g, 2 + i, 0) for g in range(3) for i in range(3)], "cell_id long, gene_id long, n long, u long")
    c = spark.range(3000).selectExpr("id AS cell_id", "id % 3 AS cluster_id")
    g = spark.range(3).selectExpr("id AS gene_id")
    monkeypatch.setattr(catalog_matrix, "_load", lambda *_: (m, c, g))
    return m, c, g


@pytest.mark.parametrize("name", ["residuals_pca", "principal_components"])
def test_components_without_genes(spark, monkeypatch, name):
    _sparse(spark, monkeypatch)
    rows = getattr(catalog_models, name)(spark, "").collect()
    assert sorted(r.cell_id for r in rows) == list(range(3000)) and all(r.factors == [] for r in rows)


def test_components_without_cells(spark):
    none = spark.createDataFrame([], "cell_id long, gene_id long, value double")
    v = factor.cell_vectors(none, spark.createDataFrame([(1, 1)], "gene_id long, rank int"), none)
    out, share = factor.principal_components(v, 3)
    assert out.count() == 0 and share == []


def test_trees_of_clusters_without_genes(spark, monkeypatch):
    _sparse(spark, monkeypatch)
    cut = {(r.cell_id % 3, r.subtree) for r in catalog_models.cut_dendrogram(spark, "").collect()}
    assert len(cut) == 3 and {s for _, s in cut} == {0, 1, 2}
    order = catalog_models.ordered_clusters(spark, "").collect()  # all ways cost the same
    assert sorted(r.cluster_id for r in order) == sorted(r.place for r in order) == [0, 1, 2]
    taken = catalog_models.multilevel_enrichment(spark, "").collect()
    assert sorted(r.gene_id for r in taken) == [0, 1, 2]


def test_doublets_without_genes(spark, monkeypatch):
    m, c, g = _sparse(spark, monkeypatch)
    rows = doublets.doublet_scores(m, c, g).collect()
    assert len(rows) == 3000 and {(r.doublet_score, r.doublet_class) for r in rows} == {(0.0, 0)}


def test_glm_factors_without_genes(spark, monkeypatch):
    m, _, g = _sparse(spark, monkeypatch)
    out, load, history = glmpca.poisson_glm_factors(m, 3, genes=g.limit(0))
    assert out.count() == 0 and out.columns == ["cell_id", "factors"] and load.shape == (0, 4) and history == []
