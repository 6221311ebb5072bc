import pytest
from pyspark.sql import functions as F

from grainfold.plans import deck, recipe, steps  # noqa: F401
from grainfold.plans.predicates import predicate
from grainfold.sources import gene_sets, orders, workspace


@pytest.mark.parametrize(
    "text,want",
    [
        ("ws.Valid == True", {1, 3}),
        ("ws.n >= 2 & ~ws.valid", {2}),
        ("(n == 1 | n == 3) and name != 'c'", {1}),
        ("not (n < 2.5)", {3}),
        ('name == "b" or valid == False', {2}),
    ],
)
def test_predicates(spark, text, want):
    d = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (3, True, "c")], "n int, valid boolean, name string")
    assert {r.n for r in d.where(predicate(text, d.columns)).collect()} == want


@pytest.mark.parametrize("text", ["", "n ==", "other > 1", "n > 1)", "(n > 1", "__import__('os')", "n > 1; drop", "n > 1 n", "n = 1"])
def test_predicates_reject(text):
    with pytest.raises(ValueError):
        predicate(text, ["n"])


def unit(*sources):
    return {"sources": list(sources)}


def a_deck(**units):
    return deck.Deck({k: deck.Unit.parse(k, v) for k, v in units.items()})


def test_order_of_chain_and_diamond():
    d = a_deck(top=unit("left", "right"), left=unit("base"), right=unit("base", "s3;ws.age > 1"), base=unit("s1", "s2"))
    order = d.order()
    assert order.index("base") < min(order.index("left"), order.index("right")) and order[-1] == "top"
    assert d.leaves() == ["top"] and d.samples("top") == ["s1", "s2", "s3"]
    assert d.units["right"].filters == (None, "ws.age > 1")
    done = {"base"}
    ran = []
    assert set(deck.build(d, lambda u: ran.append(u.name), done=done)) == {"left", "right", "top"} and done == set(d.units)
    assert deck.build(d, ran.append, dry_run=True)[-1] == "top" and "top" in done


def test_cycles_and_failures():
    with pytest.raises(ValueError, match="cycle"):
        a_deck(a=unit("b"), b=unit("a")).order()
    with pytest.raises(ValueError):
        deck.Unit.parse("a.b", {})

    def fail(u):
        if u.name == "a":
            raise RuntimeError("no")

    done = set()
    with pytest.raises(RuntimeError):
        deck.build(a_deck(a=unit("s"), b=unit("a"), c=unit("s")), fail, done=done, parallel=1)
    assert "b" not in done


def test_load_and_split(tmp_path):
    (tmp_path / "all.yaml").write_text("sources: [s1, 's2;ws.valid == True']\nonlyif: ws.age > 3\nresources: {n_cpus: 2, n_gpus: 0, memory: 10}\n")
    u = deck.Deck.load(str(tmp_path)).units["all"]
    assert u.filters == ("ws.age > 3", "ws.valid == True") and u.resources.memory == 10
    assert deck.split_units(u, 2)["all1"]["onlyif"] == "ws.subtree == 1"


def tables(spark, sf_dir):
    return {"matrix": orders.matrix(spark, sf_dir), "cells": orders.cells(spark, sf_dir), "genes": orders.genes(spark, sf_dir)}


RECIPE = [
    {"cell_summary": None},
    {"gene_summary": {}},
    {"residual_variance": {}},
    {"select_by_residuals": {"n_genes": 20}},
    {"aggregate_vectors": {"by": "cluster_id", "requests": {"n_cells": ["age", "count"]}}},
    {"aggregate_vectors": {"by": "cluster_id", "requests": {"mean_age": ["age", "mean"]}}},
    {"aggregate_counts": {}},
    {"enrichment": {}},
    {"trinarize": {}},
]


def test_recipe(spark, sf_dir, tmp_path):
    fused = recipe.fuse(RECIPE)
    assert len(fused) == len(RECIPE) - 1 and set(fused[4]["aggregate_vectors"]["requests"]) == {"n_cells", "mean_age"}
    log = []
    ws = workspace.Workspace(spark, str(tmp_path), "builds.one")
    out = recipe.run(RECIPE, tables(spark, sf_dir), workspace=ws, log=log)
    assert out["selected"].count() == 20 and set(out["clusters"].columns) == {"cluster_id", "n_cells", "mean_age"}
    assert len(log) == len(fused) and ws.read("recipe_log").count() == len(fused) and ws.exists("trinaries")
    again = recipe.run(RECIPE, {**tables(spark, sf_dir), "cluster_gene": ws.read("cluster_gene")}, resume=len(fused) - 1)
    assert again["trinaries"].count() == out["trinaries"].count()


def test_contracts(spark, sf_dir):
    t = tables(spark, sf_dir)
    with pytest.raises(AttributeError):
        recipe.run([{"select_by_residuals": {"n_genes": 2}}], t)
    with pytest.raises(ValueError):
        recipe.run([{"residual_variance": {}}], {**t, "matrix": t["matrix"].withColumn("n", F.col("n").cast("int"))})
    with pytest.raises(ValueError):
        recipe.run([{"no_such_step": {}}], t)


def test_workspace(spark, tmp_path):
    a = workspace.Workspace(spark, str(tmp_path), "samples.a")
    a.write("genes", spark.createDataFrame([(0, "G0", "A.1")], "gene_id long, gene string, accession string"))
    a.set_scalars(species="Homo sapiens")
    b = workspace.initialise(a, workspace.Workspace(spark, str(tmp_path)).child("builds").child("b"), ["gene"], ["species"])
    assert b.read("genes").columns == ["gene_id", "gene"] and b.scalars() == {"species": "Homo sapiens"}
    with pytest.raises(ValueError):
        workspace.initialise(a, b, ["total_umis"])
    a.write("genes", a.read("genes").withColumn("x", F.lit(1)))  # from itself
    assert a.read("genes").columns[-1] == "x"


def test_patch_errors(spark):
    cells = spark.createDataFrame([(1, "TenX1")], "cell_id long, sample_id string")
    table = spark.createDataFrame([("10X1", 4.0)], "sample_id string, age double")
    assert workspace.patch_sample_metadata(cells, table, {"age": "bigint"}).first().age == 4
    with pytest.raises(ValueError):
        workspace.patch_sample_metadata(cells, table, {"sex": "string"})
    with pytest.raises(ValueError):
        workspace.patch_sample_metadata(cells.withColumn("sample_id", F.lit("z")), table, {"age": "bigint"})


def test_gene_sets(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"A": {"geneSymbols": ["x", "y"]}, "B": {"geneSymbols": ["z"]}}')
    (tmp_path / "s.gmt").write_text("one\tnote\t12\t345\ntwo\tnote\t7\n")
    assert {tuple(r) for r in gene_sets.from_json(spark, str(tmp_path / "s.json")).collect()} == {("A", "x"), ("A", "y"), ("B", "z")}
    assert {tuple(r) for r in gene_sets.from_gmt(spark, str(tmp_path / "s.gmt")).collect()} == {("one", "ENSMUSG00000000012"), ("one", "ENSMUSG00000000345"), ("two", "ENSMUSG00000000007")}
    got = gene_sets.from_yaml(spark, {"a.yaml": "name: T cell\nabbreviation: TC\ndefinition: +A -B\ncategories: x y\n", "README.md": "no"}).first()
    assert (got.term, got.definition, got.categories) == ("TC", "+A -B", ["x", "y"])
    with pytest.raises(ValueError):
        gene_sets.from_yaml(spark, {"a.yaml": "name: x\n"})


def test_import_and_export(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 5\n3 1 2\n3 2 1\n")
    m = workspace.import_counts(spark, str(tmp_path / "m.mtx"))
    assert {tuple(r) for r in m.collect()} == {(1, 1, 5), (1, 3, 2), (2, 3, 1)}
    workspace.export_bundle(str(tmp_path / "out"), m, spark.range(1), spark.range(2), {"raw": m})
    assert spark.read.parquet(str(tmp_path / "out/layers/raw")).count() == 3


def test_stream(spark, tmp_path):
    from grainfold.streaming import counts

    schema = "cell_id bigint, gene_id bigint, n bigint, u bigint, ts timestamp"
    rows = [(i % 3, i % 2, i, 0, None) for i in range(10)]
    spark.createDataFrame(rows[:5], schema).write.parquet(str(tmp_path / "in"))
    for more in (rows[5:],):
        q = counts.start(counts.gene_totals(counts.read_counts(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)
        spark.createDataFrame(more, schema).write.mode("append").parquet(str(tmp_path / "in"))
        q = counts.start(counts.gene_totals(counts.read_counts(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)
    got = {r.gene_id: (r.total, r.nonzeros) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (20, 4), 1: (25, 5)}
