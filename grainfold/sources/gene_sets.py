"""Gene sets and annotation terms from JSON, GMT and YAML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, gene) of {name: {"geneSymbols": [...]}}."""
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string, struct<geneSymbols: array<string>>>")
    return whole.select(F.explode(m).alias("set_name", "s")).select("set_name", F.explode("s.geneSymbols").alias("gene"))


def from_gmt(spark: SparkSession, path: str, id_format: str | None = "ENSMUSG%011d") -> DataFrame:
    """(set_name, gene) of tab-separated lines name, description, ids; numeric ids are formatted."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f[0].alias("set_name"), F.explode(F.slice(f, 3, 1 << 20)).alias("id")).where("id <> ''")
    gene = F.format_string(id_format, F.col("id").cast("bigint")) if id_format else F.col("id")
    return rows.select("set_name", gene.alias("gene"))


def from_yaml(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(term, name, definition, categories) of annotation files {path: text}; README files are left out.

    A file needs name, abbreviation and definition; categories are optional.
    """
    import yaml

    rows = []
    for path, text in texts.items():
        if path.endswith("README.md") or not path.endswith((".yaml", ".md")):
            continue
        doc = next(d for d in yaml.safe_load_all(text) if d)
        missing = [k for k in ("name", "abbreviation", "definition") if k not in doc]
        if missing:
            raise ValueError(f"{path}: no {', '.join(missing)}")
        rows.append((doc["abbreviation"], doc["name"], doc["definition"], [c for c in str(doc.get("categories", "")).replace(",", " ").split() if c]))
    return spark.createDataFrame(rows, "term string, name string, definition string, categories array<string>")


def missing_genes(sets: DataFrame, genes: DataFrame) -> DataFrame:
    """Members of sets that the gene axis lacks."""
    return sets.join(genes.select("gene"), "gene", "left_anti")
