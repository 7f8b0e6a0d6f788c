"""A training corpus from raw documents, in stages; each reads the table that the one before it wrote.

1. quality rules: documents outside of the base rule or of their script's fertility band go;
2. near-dedup: of each class of near-duplicates the document with the least id stays;
3. decontamination: documents that hold benchmark passages go;
4. mixing: documents are taken as often as the source weights say, a repeated document as repeated rows;
5. token records: ids in framed binary files with an index, read back as one row per document.

Null and empty texts do not pass the base rule. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filigrane.llm import decontaminate, mixing, near_dedup, quality_rules, token_records
from filigrane.llm.common import materialize

#: No SQL: fertility bands and tokenizers cannot be expressed in it; tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.fertility_rules(docs, into="__judged")
    return judged.where("__judged.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, benchmark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_records.records_of(docs)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token records", records),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
