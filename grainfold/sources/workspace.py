"""Workspaces: named tables and scalars in a folder, addressed by dotted names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tenx


@dataclass(frozen=True)
class Workspace:
    """Tables under root: matrix (cell_id, gene_id, counts), cells, genes, and any others; scalars is one row."""

    spark: SparkSession
    root: str
    name: str = ""

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name.replace('.', '/')}" if self.name else self.root

    def child(self, name: str) -> Workspace:
        return Workspace(self.spark, self.root, f"{self.name}.{name}" if self.name else name)

    def read(self, table: str, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{table}")
        return df.select(*columns) if columns else df

    def exists(self, table: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/{table}").schema  # noqa: B018
            return True
        except AnalysisException:
            return False

    def write(self, table: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        """Replace or append to a table and read it back. A table may be replaced by what is computed from it."""
        target = f"{self.path}/{table}"
        if mode == "overwrite" and self.exists(table):
            from ..plans.storage import persist

            df = persist(df)
        df.write.mode(mode).parquet(target)
        return self.spark.read.parquet(target)

    def scalars(self) -> dict:
        return self.read("scalars").first().asDict() if self.exists("scalars") else {}

    def set_scalars(self, **values) -> None:
        merged = {**self.scalars(), **values}
        self.write("scalars", self.spark.createDataFrame([tuple(merged.values())], list(merged)))


def initialise(source: Workspace, target: Workspace, gene_columns: list[str], scalars: list[str] = ()) -> Workspace:
    """A new workspace with the gene axis and scalars of another; columns of cells cannot be taken over."""
    genes = source.read("genes")
    missing = [c for c in gene_columns if c not in genes.columns]
    if missing:
        raise ValueError(f"not on the gene axis: {', '.join(missing)}")
    target.write("genes", genes.select("gene_id", *[c for c in gene_columns if c != "gene_id"]))
    own = source.scalars()
    unknown = [s for s in scalars if s not in own]
    if unknown:
        raise ValueError(f"no such scalars: {', '.join(unknown)}")
    if scalars:
        target.set_scalars(**{s: own[s] for s in scalars})
    return target


def collect_cells(
    sources: list[tuple[DataFrame, DataFrame]],
    columns: list[str],
    *,
    filters: list[str | None] | None = None,
    scalars: list[dict] | None = None,
    renumber: list[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Union of filtered sources: (matrix, cells). Each source is (matrix, cells).

    columns may rename, as "old->new". A scalar of a source becomes a column of
    its cells. cell_id becomes (source << 40) + cell_id. Columns in renumber get
    labels in one range, source after source, counted on the cells that stay.
    """
    from ..operators.windows import renumber as relabel
    from ..plans.predicates import predicate

    out_m, out_c = [], []
    for i, (matrix, cells) in enumerate(sources):
        rule = filters[i] if filters else None
        kept = cells.where(predicate(rule, cells.columns)) if rule else cells
        for k, v in (scalars[i] if scalars else {}).items():
            kept = kept.withColumn(k, F.lit(v))
        pairs = [c.split("->") if "->" in c else (c, c) for c in columns]
        new_id = (F.lit(i).cast("bigint") * (1 << 40) + F.col("cell_id")).alias("cell_id")
        out_c.append(kept.select(new_id, F.lit(i).alias("source"), *[F.col(a.strip()).alias(b.strip()) for a, b in pairs]))
        out_m.append(matrix.join(kept.select("cell_id"), "cell_id", "left_semi").withColumn("cell_id", new_id))
    cells, matrix = out_c[0], out_m[0]
    for c, m in zip(out_c[1:], out_m[1:], strict=True):
        cells, matrix = cells.unionByName(c), matrix.unionByName(m)
    for c in renumber:
        cells = relabel(cells, "source", c, "_new").drop(c).withColumnRenamed("_new", c)
    return matrix, cells


def annotated_groups(posteriors: DataFrame, expression: str, threshold: float = 0.95) -> DataFrame:
    """(group_id) of the groups that an annotation expression selects: "A B ~C | D".

    Blanks are and, bars are or, ~ turns p into 1 - p; every factor of a clause
    must be over the threshold. posteriors(group_id, term, posterior).
    """
    clauses = [c.split() for c in expression.split("|") if c.split()]
    if not clauses:
        raise ValueError("an empty annotation expression")
    known = {t for c in clauses for t in c}
    terms = {t.lstrip("~") for t in known}
    have = {r.term for r in posteriors.where(F.col("term").isin(sorted(terms))).select("term").distinct().collect()}
    if terms - have:
        raise ValueError(f"no such annotations: {', '.join(sorted(terms - have))}")
    p = {t: F.max(F.when(F.col("term") == t, F.col("posterior"))).alias(f"p_{i}") for i, t in enumerate(sorted(terms))}
    at = {t: f"p_{i}" for i, t in enumerate(sorted(terms))}
    wide = posteriors.groupBy("group_id").agg(*p.values())
    keep = F.lit(False)
    for clause in clauses:
        ok = F.lit(True)
        for t in clause:
            v = F.col(at[t.lstrip("~")])
            ok = ok & ((1 - v if t.startswith("~") else v) > threshold)
        keep = keep | ok
    return wide.where(F.coalesce(keep, F.lit(False))).select("group_id")


def load_sample_metadata(samples: DataFrame, table: DataFrame, columns: list[str], *, key: str = "name", convert_10x: bool = True, lower: bool = True) -> DataFrame:
    """samples(sample_id) with columns of a metadata table, matched without regard to case; samples that are missing have nulls."""
    t = table.toDF(*[c.lower() for c in table.columns]) if lower else table
    wanted = [c.lower() if lower else c for c in columns]
    name = tenx(F.col("sample_id")) if convert_10x else F.col("sample_id")
    t = t.select(F.lower(F.col(key)).alias("_key"), *wanted)
    return samples.withColumn("_key", F.lower(name)).join(t, "_key", "left").drop("_key")


def patch_sample_metadata(cells: DataFrame, table: DataFrame, columns: dict[str, str], *, key: str = "sample_id") -> DataFrame:
    """cells with columns {name: type} of a table by sample; nulls and NaN become "" or 0. A sample that the table lacks is an error."""
    missing_columns = [c for c in columns if c not in table.columns]
    if missing_columns:
        raise ValueError(f"no such columns: {', '.join(missing_columns)}")
    name = F.regexp_replace(key, "TenX", "10X")
    unknown = cells.select(name.alias(key)).distinct().join(table.select(key), key, "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"samples without metadata: {', '.join(str(r[0]) for r in unknown)}")
    out = cells.drop(*columns).withColumn("_key", name).join(table.select(F.col(key).alias("_key"), *columns), "_key", "left").drop("_key")
    for c, kind in columns.items():
        value = F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c)) if kind != "string" else F.col(c)
        out = out.withColumn(c, F.coalesce(value.cast(kind), F.lit("" if kind == "string" else 0).cast(kind)))
    return out


#: Columns of a gene table and what stands for a missing value.
GENE_COLUMNS = {
    "full_name": "",
    "gene_type": "",
    "locus_group": "",
    "locus_type": "",
    "location": "",
    "location_sortable": "",
    "aliases": "",
    "is_tf": False,
    "dna_binding_domain": "",
    "chromosome": "",
    "chromosome_start": 0,
    "chromosome_end": 0,
}


def patch_gene_metadata(genes: DataFrame, table: DataFrame, *, on: str = "accession") -> DataFrame:
    """genes with the columns of a gene table by accession; the first of repeated accessions counts, gaps get defaults."""
    from ..operators.aggregate import first_of

    have = [c for c in GENE_COLUMNS if c in table.columns]
    one = first_of(table.select(on, *have), [on], [F.col(c) for c in have])
    out = genes.drop(*have).join(one, on, "left")
    for c in have:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(GENE_COLUMNS[c])))
    return out


def export_bundle(target: str, matrix: DataFrame, cells: DataFrame, genes: DataFrame, layers: dict[str, DataFrame] | None = None) -> None:
    """A Parquet bundle that annotated-matrix tools can load: X, obs, var and layers."""
    for name, df in {"X": matrix, "obs": cells, "var": genes, **{f"layers/{k}": v for k, v in (layers or {}).items()}}.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")


def import_counts(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, gene_id, n) from a MatrixMarket file of genes x cells, gzip or plain; comment and size lines are left out."""
    lines = spark.read.text(path).withColumn("value", F.trim("value")).where(~F.col("value").startswith("%"))
    f = F.split("value", r"\s+")
    rows = lines.select(f[0].cast("bigint").alias("gene_id"), f[1].cast("bigint").alias("cell_id"), f[2].cast("bigint").alias("n"))
    header = rows.agg(F.max("gene_id").alias("g"), F.max("cell_id").alias("c"), F.count("*").alias("k"))
    # the size line holds the greatest ids and the number of the other lines
    size = F.broadcast(header)
    return rows.crossJoin(size).where(~((F.col("gene_id") == F.col("g")) & (F.col("cell_id") == F.col("c")) & (F.col("n") == F.col("k") - 1))).select("cell_id", "gene_id", "n")
