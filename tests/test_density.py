import numpy as np

from grainfold.operators import density

SCHEMA = "cell_id long, grp long, x double, y double, eps double, least long"


def brute(points):
    """Core flags, and the sets of core points that chains of near core points join."""
    ids = [p[0] for p in points]
    xy = np.array([p[2:4] for p in points])
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= points[0][4] ** 2
    core = near.sum(1) >= points[0][5]
    of, clusters = {}, []
    for i in np.flatnonzero(core):
        if i in of:
            continue
        todo, members = [i], []
        while todo:
            j = todo.pop()
            if j not in of:
                of[j] = len(clusters)
                members.append(ids[j])
                todo += np.flatnonzero(near[j] & core).tolist()
        clusters.append(frozenset(members))
    border = {}
    for i in np.flatnonzero(~core & (near & core).any(1)):
        d = [(((xy[i] - xy[j]) ** 2).sum(), ids[j], of[j]) for j in np.flatnonzero(near[i] & core)]
        border[ids[i]] = clusters[min(d)[2]]
    return {i for i, c in zip(ids, core, strict=True) if c}, set(clusters), border


def check(spark, points):
    got = density.dbscan(spark.createDataFrame(points, SCHEMA)).collect()
    assert sorted(r.cell_id for r in got) == sorted(p[0] for p in points)
    for g in {p[1] for p in points}:
        core, clusters, border = brute([p for p in points if p[1] == g])
        mine = [r for r in got if r.grp == g]
        assert {r.cell_id for r in mine if r.core} == core
        by = {}
        for r in mine:
            if r.core:
                by.setdefault(r.cluster, set()).add(r.cell_id)
        assert {frozenset(c) for c in by.values()} == clusters
        sizes = [len(by[c]) for c in sorted(by)]
        assert sorted(by) == list(range(len(by))) and sizes == sorted(sizes, reverse=True)
        assert {r.cell_id: frozenset(by[r.cluster]) for r in mine if not r.core and r.cluster is not None} == border
    return got


def test_dbscan_equals_brute_force(spark):
    r = np.random.default_rng(4)
    points = []
    for g, (eps, least) in enumerate(((0.25, 6), (0.4, 12), (0.08, 3))):
        xy = np.concatenate([r.normal((0, 0), 0.25, (120, 2)), r.normal((2, 1), 0.15, (80, 2)), r.uniform(-2, 4, (60, 2)), np.repeat([[3.0, -1.0]], 15, 0), np.stack([np.linspace(0, 2, 50), np.zeros(50) - 1.5], 1)])
        points += [(1000 * g + i, g, float(x), float(y), eps, least) for i, (x, y) in enumerate(xy)]
    check(spark, points)
    empty = density.dbscan(spark.createDataFrame([(1, 1, None, 1.0, 1.0, 2), (2, 1, 1.0, 1.0, 0.0, 2)], SCHEMA))
    assert empty.count() == 0


def test_reach_of_kth_is_the_percentile(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for g, (n, k) in enumerate(((200, 20), (57, 6), (8, 5))):
        xy = r.standard_normal((n, 2)) * (1 + g)
        d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)), axis=1)[:, k]
        want[g] = np.percentile(d, 70)
        rows += [(1000 * g + i, g, float(x), float(y), k) for i, (x, y) in enumerate(xy)]
    got = {x.grp: x.eps for x in density.reach_of_kth(spark.createDataFrame(rows, "cell_id long, grp long, x double, y double, k long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_dispersed_clusters_break(spark):
    r = np.random.default_rng(6)
    xy = np.concatenate([r.normal(0, 1, (150, 2)), r.normal(0, 0.3, (100, 2)) + [0, 40], r.normal(0, 0.3, (60, 2)) + [12, 40], [[11.0, 41.5]], r.normal(0, 1, (12, 2)) + 90])
    label = [0] * 150 + [1] * 161 + [2] * 12
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "cell_id long, label long")
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "cell_id long, x double, y double")
    got = {x.cell_id: x.label for x in density.break_clusters(labels, places).collect()}
    parts = [{got[i] for i in span} for span in (range(150), range(150, 250), range(250, 311), range(311, 323))]
    assert [len(p) for p in parts] == [1, 1, 1, 1] and len(set.union(*parts)) == 4
