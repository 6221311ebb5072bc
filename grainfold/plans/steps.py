"""The operators as recipe steps over the tables matrix, cells, genes and what earlier steps made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, enrich, qc, residuals, select
from .recipe import step

COUNTS = {"matrix": {"cell_id": None, "gene_id": None, "n": "bigint"}}
AXES = {**COUNTS, "cells": {"cell_id": None}, "genes": {"gene_id": None}}


@step({**AXES, "genes": {"gene_id": None, "is_mt": "boolean", "is_cc": "boolean"}}, ("cells",))
def cell_summary(t):
    made = qc.cell_summary(t["matrix"], t["cells"], t["genes"])
    return {"cells": t["cells"].drop(*[c for c in made.columns if c != "cell_id"]).join(made, "cell_id")}


@step(AXES, ("gene_stats",))
def gene_summary(t, valid_fraction: float = 0.001):
    return {"gene_stats": qc.gene_summary(t["matrix"], t["genes"], t["cells"].count(), valid_fraction)}


@step({"cells": {"total_umis": None, "mito_fraction": "double", "unspliced_fraction": "double", "doublet_score": "double"}}, ("cells",))
def quality_control(t, doublet_threshold: float = 1.0, min_umis: int = 0, max_mito: float = 1.0, min_unspliced: float = 0.0):
    return {"cells": qc.quality_control(t["cells"], doublet_threshold=doublet_threshold, min_umis=min_umis, max_mito=max_mito, min_unspliced=min_unspliced)}


@step({"cells": {"valid": "boolean"}, **COUNTS}, ("cells", "matrix"))
def keep_valid(t):
    cells = t["cells"].where("valid")
    return {"cells": cells, "matrix": t["matrix"].join(cells.select("cell_id"), "cell_id", "left_semi")}


@step(AXES, ("variance",))
def residual_variance(t):
    return {"variance": residuals.residual_variance(t["matrix"], t["genes"], t["cells"].count())}


@step({"variance": {"variance": "double"}, "gene_stats": {"valid": "boolean"}}, ("selected",))
def select_by_residuals(t, n_genes: int):
    return {"selected": select.by_residuals(t["variance"], t["gene_stats"], n_genes, t.get("masked"))}


@step({"cells": {}}, ())
def aggregate_vectors(t, by: str, requests: dict, into: str = "clusters"):
    return {into: aggregate.aggregate_vector(t["cells"], by, {k: tuple(v) for k, v in requests.items()})}


@step(AXES, ("cluster_gene",))
def aggregate_counts(t, by: str = "cluster_id"):
    groups = t["cells"].select("cell_id", F.col(by).alias("group_id"))
    return {"cluster_gene": aggregate.aggregate_matrix(t["matrix"], groups, t["genes"], ["sum", "nnz", "mean", "count"])}


@step({"cluster_gene": {"mean": "double", "nnz": None, "count": None}}, ("cluster_gene",))
def enrichment(t):
    return {"cluster_gene": enrich.enrichment(t["cluster_gene"].drop("enrichment"))}


@step({"cluster_gene": {"nnz": None, "count": None}}, ("trinaries",))
def trinarize(t, f: float = 0.2):
    return {"trinaries": enrich.trinarize(t["cluster_gene"], f)}


@step({"trinaries": {"probability": "double"}, "terms": {"term": "string", "definition": "string"}, "genes": {"gene": "string"}}, ("posteriors",))
def annotate(t):
    return {"posteriors": enrich.annotate(t["trinaries"], t["genes"], t["terms"])}
