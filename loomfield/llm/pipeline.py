"""From raw documents to a training mix: five stages, each one operator over all rows its predecessor kept.

Each stage's defined results for odd rows are those of the operator it calls; an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, mixing, pii, quality, simhash
from .common import scope, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive limits."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of linked fingerprints."""
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the kind in brackets."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often: ``whole`` times in full, and the first ``extra`` words once more."""
    return mixing.mix_sources(docs).where("whole > 0 or extra > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: Fingerprints need XXH64 and the redaction a trained model, which SQL lacks; a test holds run() against each stage's rule, by
#: SQL or plain Python; it takes the spans that pii.find adds to the base ones as given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again; what a stage leaves beside
    its result, and the result before it, is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark) as own:
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
            own.forget(but=1)
    return docs
