"""Connected components of an edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(edges: DataFrame) -> DataFrame:
    """id, label for every end of edges(a, b): the least id that it is linked to.

    Every round an id takes the least label among its own and its neighbours',
    and then its label's label, so long chains halve. Each round is written to
    the shared folder; nothing is collected but the number of changes.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        jump = labels.select(F.col("id").alias("j"), F.col("label").alias("jl"))
        new = materialise(lower.join(jump, lower["l"] == jump["j"], "left").select("id", F.least("l", F.coalesce("jl", "l")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
