"""Tables of a row a gene don't pass through the driver, however small Parquet makes them."""

import re

import numpy as np
import pytest

from grainfold import catalog_matrix, catalog_models
from grainfold.operators import cluster


def broadcasts(df):
    """What is read below each broadcast of the plan that has no aggregate or join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :|+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            stop = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            below = " ".join(lines[i + 1 : stop])
            if not re.search("Join|Aggregate", below):
                yield below


@pytest.mark.parametrize("query", ["copy_numbers", "smoothed_karyotype"])
def test_genes_are_not_broadcast(spark, sf_dir, query):
    assert not [b for b in broadcasts(getattr(catalog_models, query)(spark, sf_dir)) if "p_partkey" in b]


def test_genes_of_the_tree_are_not_broadcast(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(cluster, "dendrogram", lambda groups, selected: (groups, selected))
    groups, *parts, _ = catalog_models._tree(spark, sf_dir)
    for d in (groups, *parts):
        assert not [b for b in broadcasts(d) if "p_partkey" in b]
    assert catalog_matrix._no_broadcast(groups).columns == groups.columns


def test_chain_over_several_blocks(spark, monkeypatch):
    x = np.repeat([2.0, 3.0, 1.0, 2.0], 6_000)
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g int, i int, p double")
    got = [r.state for r in cluster.viterbi(d, ["g"], "i", "p").orderBy("i").collect()]
    assert got == x.astype(int).tolist()
