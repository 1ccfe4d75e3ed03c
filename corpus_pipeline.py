"""From raw documents to packed training sequences, stage by stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on everything that its predecessor
kept; ``run`` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import decontaminate, packing, pii, quality, similar
from shardloom.llm.common import discard, settle, settled_so_far
from shardloom.llm.queries import tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    model = quality.fit_compression_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five-word shingles, 0.8) stays: that of the smallest id."""
    return similar.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited by up to a fifth of its words, go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data in a text gives way to its kind; no document goes."""
    return pii.mask_spans(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.op10(docs, tokenizer_file())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's scores and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Stages before it run while the frame is made.

    Null and empty texts are documents like others to every stage; rows with equal id and text are near
    copies, of which one stays; an empty table gives no rows; further columns pass all stages but the last.
    What a stage wrote for itself is deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = settled_so_far()
        docs = settle(stage(spark, docs, sf_dir), name)
        discard(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
