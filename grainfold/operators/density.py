"""Density clusters in the plane, for all groups in the same jobs.

A grid whose cells have eps for a diagonal is the index: points of one cell are
neighbours of each other, and all others lie within two cells. A cell of enough
points has only core points, so pairs are counted only for points of thinner
cells. Cells with core points are the nodes of a graph; two are linked if core
points of theirs are neighbours; its components are the clusters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import persist
from .graph import connected_components
from .windows import positions

#: Cells within two steps: beyond them no two points are within eps.
STEPS = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
#: Relative error of ranks in medians and percentiles of a group.
ACCURACY = 100_000


def _near(a: str, b: str, radius: Column) -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return dx * dx + dy * dy <= radius * radius


def _spread(df: DataFrame, *columns) -> DataFrame:
    """df once for each cell within two steps, as gx, gy."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in STEPS])
    d = df.select(*columns, "gx", "gy", F.explode(steps).alias("s"))
    return d.withColumns({"gx": F.col("gx") + F.col("s.i"), "gy": F.col("gy") + F.col("s.j")}).drop("s")


def dbscan(points: DataFrame) -> DataFrame:
    """(cell_id, grp, x, y, core, cluster) of points(cell_id, grp, x, y, eps, least); eps and least are those of the group.

    A core point has `least` points within eps, itself included. Core points
    within eps share a cluster; another point within eps of a core point is in
    the cluster of the nearest one (then of the least cell_id); the rest have
    cluster null. Clusters of a group count from 0, the largest in core points
    first. Points at one place count each but meet others as one. Rows with a
    null or NaN place or without a positive eps drop out.

    Work: a point meets those within two cells of a thin cell, and the distinct
    core points of two neighbouring cells whose outermost points are not
    neighbours already.
    """
    sound = points.where("eps > 0 and x is not null and y is not null and not isnan(x) and not isnan(y)")
    width = F.col("eps") / math.sqrt(2)
    p = persist(sound.select("cell_id", "grp", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("eps").cast("double").alias("eps"), "least", F.floor(F.col("x") / width).alias("gx"), F.floor(F.col("y") / width).alias("gy")))
    key = ["grp", "gx", "gy"]
    cells = persist(p.groupBy(*key).agg(F.count("*").alias("n"), F.first("least").alias("least")))
    thin = cells.where("n < least").select(*key)
    places = persist(p.groupBy(*key, "x", "y").agg(F.count("*").alias("n"), F.first("eps").alias("eps"), F.first("least").alias("least")))
    # points of thin cells, by place: how many are near
    asked = places.join(thin, key, "left_semi").select(*key, F.col("x").alias("ax"), F.col("y").alias("ay"), "eps", "least")
    others = _spread(places, "grp", F.col("x").alias("bx"), F.col("y").alias("by"), "n").join(thin, key, "left_semi")
    met = asked.join(others, key).where(_near("a", "b", F.col("eps"))).groupBy(*key, "ax", "ay").agg(F.sum("n").alias("met"), F.first("least").alias("least"))
    some = met.where("met >= least").select(*key, F.col("ax").alias("x"), F.col("ay").alias("y"))
    every = places.join(cells.where("n >= least").select(*key), key, "left_semi").select(*key, "x", "y")
    eps = p.groupBy("grp").agg(F.first("eps").alias("eps"))
    core = persist(some.unionByName(every).join(eps, "grp"))
    label = persist(_components(core, key))
    # clusters by size
    weight = places.join(core.select(*key, "x", "y"), [*key, "x", "y"], "left_semi").join(label, key)
    size = weight.groupBy("grp", "unit").agg(F.sum("n").alias("n"), F.min(F.struct("x", "y")).alias("first"))
    ranked = positions(size, [F.col("grp"), F.desc("n"), F.col("first"), F.col("unit")], "at")
    begin = ranked.groupBy("grp").agg(F.min("at").alias("begin"))
    code = ranked.join(begin, "grp").select("grp", "unit", (F.col("at") - F.col("begin")).alias("cluster"))
    named = persist(core.join(label, key).join(code, ["grp", "unit"]).select(*key, "x", "y", "cluster"))
    inside = p.join(named, [*key, "x", "y"]).select("cell_id", "grp", "x", "y", F.lit(True).alias("core"), "cluster")
    outer = persist(p.join(named.select(*key, "x", "y"), [*key, "x", "y"], "left_anti").withColumn("row", F.monotonically_increasing_id()))
    first = p.join(named, [*key, "x", "y"]).groupBy(*key, "x", "y", "cluster").agg(F.min("cell_id").alias("least_id"))
    reach = outer.select(*key, "row", F.col("x").alias("ax"), F.col("y").alias("ay"), "eps").join(_spread(first, "grp", F.col("x").alias("bx"), F.col("y").alias("by"), "cluster", "least_id"), key)
    far = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    best = reach.where(_near("a", "b", F.col("eps"))).groupBy("row").agg(F.min(F.struct(far.alias("far"), "least_id", "cluster")).alias("m")).select("row", F.col("m.cluster").alias("cluster"))
    return inside.unionByName(outer.join(best, "row", "left").select("cell_id", "grp", "x", "y", F.lit(False).alias("core"), "cluster"))


def _components(core: DataFrame, key: list[str]) -> DataFrame:
    """(grp, gx, gy, unit): the component of each cell with core points."""
    outermost = [F.min(F.struct("x", "y")), F.max(F.struct("x", "y")), F.min(F.struct("y", "x")), F.max(F.struct("y", "x"))]
    cell = core.groupBy(*key).agg(F.first("eps").alias("eps"), *[m.alias(f"e{i}") for i, m in enumerate(outermost)])
    corners = F.array(*[F.struct(F.col(f"e{i}.x").alias("x"), F.col(f"e{i}.y").alias("y")) for i in range(4)])
    units = persist(positions(cell.select(*key, "eps", corners.alias("corners")), [F.col(c) for c in key], "unit"))
    near = _spread(units, "grp", F.col("unit").alias("other"), F.col("corners").alias("theirs")).join(units.select(*key, "unit", "corners", "eps"), key).where("unit < other")
    touch = F.exists("corners", lambda a: F.exists("theirs", lambda b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) <= F.col("eps") * F.col("eps")))
    near = persist(near.withColumn("touch", touch).select("unit", "other", "touch"))
    of = core.join(units.select(*key, "unit"), key)
    open_ = near.where("not touch").select("unit", "other")
    a = open_.join(of.select("unit", F.col("x").alias("ax"), F.col("y").alias("ay"), "eps"), "unit")
    pair = a.join(of.select(F.col("unit").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by")), "other").where(_near("a", "b", F.col("eps"))).groupBy("unit", "other").agg(F.lit(1).alias("one"))
    linked = near.where("touch").select("unit", "other").unionByName(pair.select("unit", "other"))
    parts = connected_components(linked.select(F.col("unit").alias("src"), F.col("other").alias("dst")))
    joined = units.select(*key, F.col("unit").alias("id")).join(parts, "id", "left")
    return joined.select(*key, F.coalesce("component", "id").alias("unit"))


# --- breaking clusters ---------------------------------------------------------------------------


def standardised(points: DataFrame) -> DataFrame:
    """points(cell_id, grp, x, y) on the principal axes of their group, each with deviation 1 (0 where there is none)."""
    m = points.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    turn = m.withColumn("angle", 0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")))
    dx, dy, cos, sin = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.cos("angle"), F.sin("angle")
    d = points.join(turn, "grp").select("cell_id", "grp", (dx * cos + dy * sin).alias("u"), (dy * cos - dx * sin).alias("v"))
    s = d.groupBy("grp").agg(F.stddev_pop("u").alias("su"), F.stddev_pop("v").alias("sv"))
    scaled = lambda v, by: F.coalesce(F.try_divide(F.col(v), F.when(F.col(by) > 1e-12, F.col(by))), F.lit(0.0))
    return d.join(s, "grp").select("cell_id", "grp", scaled("u", "su").alias("x"), scaled("v", "sv").alias("y"))


def outlying(points: DataFrame, rounds: int = 5, bound: float = 3.5) -> DataFrame:
    """points(cell_id, grp, x, y) with `outlier`: far by the median distance from the median, axis by axis, anew among the rest in every round.

    Medians are approximate beyond ACCURACY points of a group (ranks to 1 in ACCURACY).
    """
    d = persist(points.withColumn("outlier", F.lit(False)))
    for _ in range(rounds):
        for axis in ("x", "y"):
            rest = d.where("not outlier")
            mid = rest.groupBy("grp").agg(F.percentile_approx(axis, 0.5, ACCURACY).alias("mid"))
            apart = F.abs(F.col(axis) - F.col("mid"))
            mad = rest.join(mid, "grp").groupBy("grp").agg(F.first("mid").alias("mid"), F.percentile_approx(apart, 0.5, ACCURACY).alias("mad"))
            d = d.join(mad, "grp", "left").withColumn("outlier", F.col("outlier") | F.coalesce(0.6745 * apart > bound * F.col("mad"), F.lit(False))).drop("mid", "mad")
        d = persist(d)
    return d


def reach_of_kth(points: DataFrame, percentile: float = 0.7) -> DataFrame:
    """(grp, eps): the percentile over a group's points of the distance to the k-th nearest other; points(cell_id, grp, x, y, k).

    Each group has a grid of its own, twice as wide in every round. A point is
    settled once its k-th neighbour is nearer than a cell; a group is done once
    enough of its points are, so outlying points never search far. Every round
    looks at the points of nine cells around an unsettled one.
    """
    n = points.groupBy("grp").agg(F.count("*").alias("n"), F.first("k").alias("k"))
    todo = persist(points.select("cell_id", "grp", "x", "y", "k").join(n.select("grp", "n"), "grp").where("k >= 1 and n > k").withColumn("width", F.sqrt(F.col("k") / F.col("n"))))
    base = todo
    kept = None
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for level in range(64):
        w = F.col("width") * float(2**level)
        live = todo.select("grp").distinct()
        grid = base.join(live, "grp", "left_semi").select(F.col("cell_id").alias("other"), "grp", F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / w).alias("gx"), F.floor(F.col("y") / w).alias("gy"), F.explode(ring).alias("s"))
        grid = grid.select("other", "grp", "bx", "by", (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"))
        asked = todo.select("cell_id", "grp", F.col("x").alias("ax"), F.col("y").alias("ay"), "k", w.alias("w"), F.floor(F.col("x") / w).alias("gx"), F.floor(F.col("y") / w).alias("gy"))
        far = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
        met = asked.join(grid, ["grp", "gx", "gy"]).where(F.col("cell_id") != F.col("other")).withColumn("far", far).where("far <= w")
        kth = met.groupBy("grp", "cell_id").agg(F.first("k").alias("k"), F.array_sort(F.collect_list("far")).alias("f")).where(F.size("f") >= F.col("k"))
        found = persist(kth.select("grp", "cell_id", F.element_at("f", F.col("k").cast("int")).alias("radius")))
        kept = found if kept is None else persist(kept.unionByName(found))
        have = kept.groupBy("grp").agg(F.count("*").alias("have"))
        need = F.floor(percentile * (F.col("n") - 1)) + 2
        short = n.join(have, "grp", "left").where(F.coalesce("have", F.lit(0)) < F.least(need, F.col("n"))).select("grp")
        todo = persist(todo.join(short, "grp", "left_semi").join(found.select("grp", "cell_id"), ["grp", "cell_id"], "left_anti"))
        if not todo.limit(1).count():
            break
    # a settled point is nearer to its k-th neighbour than any unsettled one of the group, so the percentile is that of all
    at = positions(kept, [F.col("grp"), F.col("radius"), F.col("cell_id")], "at")
    begin = at.groupBy("grp").agg(F.min("at").alias("begin")).join(n.select("grp", "n"), "grp").withColumn("want", percentile * (F.col("n") - 1))
    two = at.join(begin, "grp").withColumn("nth", F.col("at") - F.col("begin")).where("nth = floor(want) or nth = ceil(want)")
    return two.groupBy("grp").agg((F.min("radius") + (F.max("radius") - F.min("radius")) * F.first(F.col("want") - F.floor("want"))).alias("eps"))


def break_clusters(labels: DataFrame, places: DataFrame, min_size: int = 10) -> DataFrame:
    """(cell_id, label): clusters that are dispersed on a layout are split by density; labels(cell_id, label), places(cell_id, x, y).

    A cluster of 2 x min_size cells or more is looked at on its standardised
    principal axes. With k = a tenth of its cells (5 to 50) and eps the 70th
    percentile of the distance to the k-th nearest, it stays whole if at most
    three cells are outliers and k / 2 cells lie within eps of its centre; else
    its parts are those of dbscan with eps and k / 2. A cell without a part joins
    that of the nearest cell that has one. Labels of the result count from 0, by
    old label, then by size of the part; cells without a place keep theirs.
    """
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    big = size.where(F.col("n") >= 2 * min_size).select("label")
    p = labels.join(big, "label", "left_semi").join(places, "cell_id").select("cell_id", F.col("label").alias("grp"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = persist(standardised(p))
    n = p.groupBy("grp").agg(F.count("*").alias("n"))
    k = F.least(F.lit(50), F.col("n") - 1, F.greatest(F.lit(5), F.rint(F.col("n") / 10.0))).cast("long")
    n = persist(n.select("grp", "n", k.alias("k")))
    p = persist(p.join(n.select("grp", "k"), "grp"))
    eps = persist(reach_of_kth(p))
    odd = outlying(p.select("cell_id", "grp", "x", "y")).join(eps, "grp").join(n.select("grp", "k"), "grp")
    seen = odd.groupBy("grp").agg(F.count_if("outlier").alias("outliers"), F.count_if(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < F.col("eps")).alias("middle"), F.first("k").alias("k"))
    split = seen.where((F.col("outliers") > 3) | (F.col("middle") < F.col("k") * 0.5)).select("grp")
    q = p.join(split, "grp", "left_semi").join(eps, "grp").select("cell_id", "grp", "x", "y", "eps", F.greatest(F.lit(1), F.rint(F.col("k") * 0.5)).cast("long").alias("least"))
    part = persist(nearest_part(dbscan(q)))
    every = labels.join(part.select("cell_id", "cluster"), "cell_id", "left").select("cell_id", "label", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    code = positions(every.select("label", "cluster").distinct(), [F.col("label"), F.col("cluster")], "new")
    return every.join(code, ["label", "cluster"]).select("cell_id", F.col("new").alias("label"))


def nearest_part(found: DataFrame) -> DataFrame:
    """found of dbscan with the cluster of the nearest point that has one (of two the least cell_id) for each point without.

    Grids of doubling width: a point is settled once its nearest is nearer than a
    cell. A group without any cluster gets cluster 0.
    """
    known = persist(found.where("cluster is not null"))
    lost = persist(found.where("cluster is null").withColumn("row", F.monotonically_increasing_id()).join(known.select("grp").distinct().withColumn("some", F.lit(1)), "grp", "left"))
    done = lost.where("some is null").select("cell_id", "grp", "x", "y", "core", F.lit(0).cast("long").alias("cluster"))
    todo = persist(lost.where("some = 1").drop("some", "cluster"))
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    w = 0.0625
    while todo.limit(1).count():
        grid = known.join(todo.select("grp").distinct(), "grp", "left_semi").select(F.col("cell_id").alias("other"), "cluster", "grp", F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / w).alias("gx"), F.floor(F.col("y") / w).alias("gy"), F.explode(ring).alias("s"))
        grid = grid.select("other", "cluster", "grp", "bx", "by", (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"))
        asked = todo.select("row", "grp", F.col("x").alias("ax"), F.col("y").alias("ay"), F.floor(F.col("x") / w).alias("gx"), F.floor(F.col("y") / w).alias("gy"))
        far = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
        met = asked.join(grid, ["grp", "gx", "gy"]).withColumn("far", far).where(F.col("far") <= w * w)
        best = persist(met.groupBy("row").agg(F.min(F.struct("far", "other", "cluster")).alias("m")).select("row", F.col("m.cluster").alias("cluster")))
        done = done.unionByName(todo.join(best, "row").select("cell_id", "grp", "x", "y", "core", "cluster"))
        todo = persist(todo.join(best, "row", "left_anti"))
        w *= 2
    return known.unionByName(done)
