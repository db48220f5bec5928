"""A corpus from raw documents to a weighted mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns all that it keeps; ``run`` writes each result as Parquet to the
shared folder and reads it as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canloom.llm import decontam, mixing, pii, simhash, toxicity
from canloom.llm.common import documents, materialize, scratch

#: Learnt models, an index and random rounding: SQL can't state them. Tests hold the stages to brute force.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars as the texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more of five words."""
    return simhash.one_of_similar(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes for itself goes once its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", result=True)
    return STAGES[-1][1](spark, docs, sf_dir)
