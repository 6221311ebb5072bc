from collections import Counter

import numpy as np

from grainfold.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, q string, node string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "q", "node") for i, v in vectors], SCHEMA)


def brute(vectors, k=20):
    """For each row that asks: query_id and the list of (vec_id, score) of its nearest other rows."""
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = []
    for a, (q, x) in enumerate(sound):
        if q % 20 == 0:
            scores = sorted((-float(sum(x * y)), i) for b, (i, y) in enumerate(sound) if b != a)[:k]
            out.append((q, [(i, -s) for s, i in scores]))
    return out


def check(spark, vectors, recall=0.9):
    from pyspark.sql import functions as F

    rows = nn_descent.nearest(frame(spark, vectors), F.col("vec_id") % 20 == 0).collect()
    want = brute(vectors)
    assert Counter(r.query_id for r in rows) == sum((Counter({q: len(x)}) for q, x in want), Counter())
    got = {}
    for r in rows:
        got.setdefault((r.query_id, r["rank"]), []).append((r.vec_id, r.score))
    found = []
    for q in {q for q, _ in want}:
        lists = [x for p, x in want if p == q]  # rows of one id ask alike only if their vectors are equal
        for n in range(1, 21):
            expected = sorted(x[n - 1] for x in lists if len(x) >= n)
            here = sorted(got.get((q, n), []))
            assert len(here) == len(expected)
            found += [e[0] in {i for m in range(1, 21) for i, _ in got.get((q, m), [])} for e in expected]
        for x in lists:
            scores = dict(x)
            for n in range(1, 21):
                for i, s in got.get((q, n), []):
                    assert len(lists) > 1 or i not in scores or abs(scores[i] - s) < 1e-9
    assert not found or np.mean(found) >= recall


def test_recall_and_bad_vectors(spark):
    r = np.random.default_rng(0)
    vectors = [(i, r.standard_normal(8).tolist()) for i in range(900)]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] + [0.0] * 7), (1004, [float("inf")] + [0.0] * 7), (1005, [1.0]), (None, [1.0] * 8), (1020, [])]
    check(spark, vectors + bad + vectors[:3])


def test_rows_of_one_id_are_candidates(spark):
    """Two rows of the query's id with other vectors: both ask, and each finds the other."""
    from pyspark.sql import functions as F

    rows = [(0, [1.0] * 8), (0, [2.0] * 8), (3, [1.5] * 8)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nn_descent.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 0, 16.0), (0, 1, 3, 24.0), (0, 2, 0, 16.0), (0, 2, 3, 12.0)]


def test_copies_and_ties(spark):
    r = np.random.default_rng(1)
    one = r.standard_normal(8).tolist()
    check(spark, [(i, one) for i in range(300)] + [(i, r.standard_normal(8).tolist()) for i in range(300, 360)])


def test_few_and_none(spark):
    check(spark, [(0, [1.0] * 8)])
    check(spark, [(0, [1.0] * 8), (20, [2.0] * 8), (3, [-1.0] * 8)], 1.0)
    check(spark, [])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from grainfold.llm import near_dups, packing, phrase_parse, pseudonyms, quality_rules
    from grainfold.llm.shared import materialise

    from . import cases
    from .test_duplicates import classes

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf_dir))
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
            kept.append({r.doc_id: r.text for r in docs.collect()})
    judged = {r.doc_id: r.kept for r in quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality_rules.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)).collect()}
    assert set(kept[0]) == {d for d, k in judged.items() if k}
    want = classes(list(kept[0].items()))
    assert set(kept[1]) == {d for d, c in want.items() if c == d}
    first = {}
    for d in sorted(kept[1]):
        b = kept[1][d].encode()
        off = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], d) < d:
                off[p : p + 50] = b"\1" * 50
        assert kept[2][d] == bytes(x for x, o in zip(b, off, strict=True) if not o).decode("utf-8", "ignore")
    assert set(kept[3]) == set(kept[2])
    assert sum(kept[3][d] != kept[2][d] for d in kept[3]) > 0
    assert set(r.doc_id for r in docs.select("doc_id").distinct().collect()) == set(kept[3])
    for name, stage in corpus_pipeline.STAGES:  # nulls, ties and clashing names
        clashing = cases.clashing(spark).withColumn("_pseudonyms", F.lit("mine"))
        odd = stage(spark, clashing, sf_dir)
        assert odd.count() > 0
        if name != "packing":
            assert odd.columns == clashing.columns and odd.where("_pseudonyms <> 'mine' or pii <> 'pii'").count() == 0
        stage(spark, cases.frame(spark, []), sf_dir).count()
