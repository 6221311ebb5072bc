"""Shards by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree. On each level every child draws -ln(u) / weight, where
u in (0, 1) is a hash of the row's key and the child's path; the least draw
wins, so a child is chosen in proportion to its weight (the sum of the weights
of its shards). A draw depends on the key and the child alone. If the weight of
a shard changes, only choices between the siblings on its path change, and rows
move only between subtrees whose weights change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise, table, text_or_empty

Tree = dict[str, dict[str, dict[int, float]]]

#: Hex digits of a hash that make a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


def even_tree(n_shards: int, racks: int = 6, regions: int = 2) -> Tree:
    """Shards of weight 1 dealt evenly over racks, and racks over regions."""
    tree: Tree = {}
    for shard in range(n_shards):
        rack = shard * racks // n_shards
        region = rack * regions // racks
        tree.setdefault(f"g{region}", {}).setdefault(f"k{rack}", {})[shard] = 1.0
    return tree


def grown_tree(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own.

    As a region of its own its draw competes with unchanged draws of the old
    regions, so it takes rows only into itself. Within an old rack it would
    also raise that rack's weight and draw rows to the shard's older siblings.
    """
    region = f"g{len(tree)}"
    return {**tree, region: {f"k{sum(map(len, tree.values()))}": {shard: weight}}}


def _uniform(key: Column, path: str) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("|" + path)).cast("binary")), 1, DRAW_DIGITS)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << (4 * DRAW_DIGITS))


def _draws(key: Column, children: dict[str, float]) -> Column:
    """The least (draw, path) of the children with a positive weight."""
    live = {path: w for path, w in children.items() if w > 0}
    if not live:
        raise ValueError("a level without a positive weight")
    return F.array_min(
        F.array(*[F.struct((-F.ln(_uniform(key, p)) / F.lit(float(w))).alias("draw"), F.lit(p).alias("path")) for p, w in live.items()])
    )


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: three nested choices, each evaluated on its branch only."""
    weight = lambda x: sum(x.values()) if all(not isinstance(v, dict) for v in x.values()) else sum(weight(v) for v in x.values())
    region_of = _draws(key, {g: weight(racks) for g, racks in tree.items()})["path"]
    out = None
    for g, racks in tree.items():
        if weight(racks) <= 0:
            continue
        rack_of = _draws(key, {f"{g}/{k}": weight(shards) for k, shards in racks.items()})["path"]
        in_region = None
        for k, shards in racks.items():
            if weight(shards) <= 0:
                continue
            leaf = _draws(key, {f"{g}/{k}/{s}": w for s, w in shards.items()})["path"]
            leaf = F.substring_index(leaf, "/", -1).cast("int")
            in_region = F.when(rack_of == f"{g}/{k}", leaf) if in_region is None else in_region.when(rack_of == f"{g}/{k}", leaf)
        out = F.when(region_of == g, in_region) if out is None else out.when(region_of == g, in_region)
    return out


def shard_rows(docs: DataFrame, tree: Tree, grown: Tree | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc key, size, text_crc32, law, shard, slot, grown_shard of every row.

    A null key counts as the word null, a null text as empty (size 8). Repeated
    rows each get a slot. Slots count from 0 in each shard, in the order of a
    hash: rows are ranked in hash ranges, whose counts give the offsets, so that
    no task holds a whole shard. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = text_or_empty(text)
    base = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    base = base.withColumn("shard", place(F.col("k"), tree)).withColumn(
        "grown_shard", place(F.col("k"), grown) if grown else F.lit(None).cast("int")
    )
    order = F.md5(F.concat_ws("|", "k", F.col("text_crc32").cast("string"), F.col("size").cast("string"), F.lit("slot")).cast("binary"))
    base = base.withColumn("h", F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint"))
    base = materialise(base.drop("k")).withColumn("range", (F.col("h") * ranges / float(1 << 32)).cast("int"))
    counts = base.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("shard", "range").orderBy("h", "doc_id", "text_crc32", "size")
    return (
        base.join(offsets, ["shard", "range"])
        .withColumn("slot", (F.col("skip") + F.row_number().over(inside) - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
    )


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(24)
    return shard_rows(table(spark, sf_dir, "documents"), tree, grown_tree(tree, 24))
