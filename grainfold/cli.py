"""Command line: python -m grainfold.cli {init,qc,process,build,leaves,import}.

A project folder holds config.yaml (root of the workspaces, recipes), the work
units in units/*.yaml, and recipes/*.yaml.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import recipe, steps  # noqa: F401  registers the steps
from .plans.deck import Deck, Unit, build
from .sources import workspace


def _config(folder: str) -> dict:
    import yaml

    out: dict = {"root": os.path.join(folder, "data"), "recipes": {}}
    if os.path.exists(p := os.path.join(folder, "config.yaml")):
        with open(p) as f:
            out |= yaml.safe_load(f) or {}
    folder = os.path.join(folder, "recipes")
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        with open(os.path.join(folder, name)) as f:
            out["recipes"][name.removesuffix(".yaml")] = yaml.safe_load(f)
    return out


def _recipe(config: dict, named) -> list:
    if isinstance(named, list):
        return named
    if named not in config["recipes"]:
        raise SystemExit(f"no recipe {named}")
    return config["recipes"][named]


def process(spark: SparkSession, config: dict, deck: Deck, unit: Unit, resume: int = 0) -> None:
    """Collect the unit's sources and run its recipe in builds.<unit>."""
    top = workspace.Workspace(spark, config["root"])
    target = top.child(f"builds.{unit.name}")
    sources = [top.child(f"builds.{s}" if s in deck.units else f"samples.{s}") for s in unit.sources]
    pairs, filters = [(s.read("matrix"), s.read("cells")) for s in sources], list(unit.filters)
    if unit.with_annotation:
        pairs = [(m, c.join(workspace.annotated_groups(s.read("posteriors"), unit.with_annotation).withColumnRenamed("group_id", "cluster_id"), "cluster_id", "left_semi")) for s, (m, c) in zip(sources, pairs, strict=True)]
    columns = [c for c in pairs[0][1].columns if c not in ("cell_id", "source") and all(c in x.columns for _, x in pairs)]
    matrix, cells = workspace.collect_cells(pairs, columns, filters=filters, scalars=[s.scalars() for s in sources] if all(s.scalars() for s in sources) else None)
    tables = {"matrix": target.write("matrix", matrix), "cells": target.write("cells", cells), "genes": target.write("genes", sources[0].read("genes"))}
    recipe.run(_recipe(config, unit.recipe), tables, resume=resume, workspace=target)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="grainfold")
    p.add_argument("--folder", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    sub.add_parser("leaves")
    q = sub.add_parser("qc")
    q.add_argument("samples", nargs="+")
    q.add_argument("--force", action="store_true")
    q = sub.add_parser("process")
    q.add_argument("unit")
    q.add_argument("--resume", type=int, default=0)
    q = sub.add_parser("build")
    q.add_argument("--dryrun", action="store_true")
    q.add_argument("--parallel", type=int, default=4)
    q = sub.add_parser("import")
    q.add_argument("sample")
    q.add_argument("matrix")
    a = p.parse_args(argv)
    if a.command == "init":
        for d in ("units", "recipes", "data"):
            os.makedirs(os.path.join(a.folder, d), exist_ok=True)
        return 0
    config = _config(a.folder)
    units = os.path.join(a.folder, "units")
    deck = Deck.load(units) if os.path.isdir(units) else Deck({})
    if a.command == "leaves":
        print("\n".join(deck.leaves()))
        return 0
    if a.command == "build" and a.dryrun:
        print("\n".join(build(deck, lambda u: None, dry_run=True)))
        return 0
    spark = SparkSession.builder.appName("grainfold").getOrCreate()
    top = workspace.Workspace(spark, config["root"])
    if a.command == "import":
        ws = top.child(f"samples.{a.sample.replace('TenX', '10X')}")
        m = ws.write("matrix", workspace.import_counts(spark, a.matrix).withColumn("u", F.lit(0).cast("bigint")))
        ws.write("cells", m.select("cell_id").distinct())
        ws.write("genes", m.select("gene_id").distinct())
    elif a.command == "qc":
        names = [s for n in a.samples for s in (deck.samples(n) if n in deck.units else [n])]
        for s in dict.fromkeys(names):
            ws = top.child(f"samples.{s}")
            if not a.force and "passed_qc" in ws.scalars():
                continue
            out = recipe.run(_recipe(config, "qc"), {t: ws.read(t) for t in ("matrix", "cells", "genes")}, workspace=ws)
            good = out["cells"].agg(F.avg(F.col("valid").cast("double"))).first()[0] or 0.0
            ws.set_scalars(passed_qc=good >= config.get("min_fraction_good_cells", 0.0))
    elif a.command == "process":
        process(spark, config, deck, deck.units[a.unit], a.resume)
    elif a.command == "build":
        done = {n for n in deck.units if "completed" in top.child(f"builds.{n}").scalars()}

        def run(u: Unit) -> None:
            process(spark, config, deck, u)
            top.child(f"builds.{u.name}").set_scalars(completed=True)

        build(deck, run, done=done, parallel=a.parallel)
    return 0


if __name__ == "__main__":
    sys.exit(main())
