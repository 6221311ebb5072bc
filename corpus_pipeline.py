"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet into the shared folder and rereads it as the next stage's docs. All
stages but the last return the columns of documents, extra ones too.

Null and empty texts have too few words and go in the first stage. Of rows that
share an id one stays, by the second stage; rows without an id are kept by it
and have no near duplicates. An empty table passes through all stages and gives
no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm import near_dups, packing, phrase_parse, pseudonyms, quality_rules
from grainfold.llm.shared import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the boosted trees reject go."""
    return quality_rules.keep_documents(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the least doc_id."""
    return near_dups.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has go from the texts; n_chars follows."""
    return _as(docs, phrase_parse.remove_repeats(docs, counts=False))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms; n_chars follows."""
    report = "_pseudonyms"
    while report in docs.columns:  # docs keeps its columns, whatever their names
        report = f"_{report}"
    return _as(docs, pseudonyms.pseudonymise(docs, pseudonyms.DEMO_KEY, report=report))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences, with their token ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=100_000)


def _as(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, with the length of the changed text where they have one."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeats), ("personal data", pii), ("packing", pack)]

#: Models, hashing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
