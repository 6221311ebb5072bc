from pyspark.sql import functions as F

from grainfold import cli
from grainfold.sources import orders, workspace


def project(spark, tmp_path, sf_dir):
    folder = str(tmp_path)
    assert cli.main(["--folder", folder, "init"]) == 0
    (tmp_path / "recipes" / "default.yaml").write_text("- gene_summary: {}\n- residual_variance: {}\n- select_by_residuals: {n_genes: 10}\n")
    (tmp_path / "recipes" / "qc.yaml").write_text("- cell_summary:\n- quality_control: {min_umis: 500}\n")
    (tmp_path / "units" / "all.yaml").write_text("sources: [BUILDING, 'FURNITURE;ws.age > 3']\nonlyif: ws.age <= 3\n")
    (tmp_path / "units" / "top.yaml").write_text("sources: [all]\n")
    (tmp_path / "config.yaml").write_text("min_fraction_good_cells: 0.1\n")
    m, c, g = orders.matrix(spark, sf_dir), orders.cells(spark, sf_dir), orders.genes(spark, sf_dir)
    for s in ("BUILDING", "FURNITURE"):
        ws = workspace.Workspace(spark, f"{folder}/data", f"samples.{s}")
        cells = ws.write("cells", c.where(F.col("chemistry") == s))
        ws.write("matrix", m.join(cells.select("cell_id"), "cell_id", "left_semi"))
        ws.write("genes", g)
    return folder


def test_project(spark, tmp_path, sf_dir, capsys):
    folder = project(spark, tmp_path, sf_dir)
    cli.main(["--folder", folder, "leaves"])
    cli.main(["--folder", folder, "build", "--dryrun"])
    assert capsys.readouterr().out.split() == ["top", "all", "top"]
    cli.main(["--folder", folder, "qc", "all"])
    top = workspace.Workspace(spark, f"{folder}/data")
    assert top.child("samples.BUILDING").scalars()["passed_qc"] in (True, False)
    assert "valid" in top.child("samples.FURNITURE").read("cells").columns
    cli.main(["--folder", folder, "build"])
    one, two = top.child("builds.all"), top.child("builds.top")
    assert one.read("selected").count() == 10 and two.scalars()["completed"]
    cells = one.read("cells")
    assert cells.where("chemistry = 'BUILDING' and age > 3 or chemistry = 'FURNITURE' and age <= 3").count() == 0 and cells.count() > 0
    cli.main(["--folder", folder, "build"])  # nothing is left to do
