"""The thin queries over the standard tables, one an operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer_file() -> str:
    """The public byte-level BPE file that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import op1

    return op1(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import op2

    return op2(_table(spark, sf_dir, "documents"))


def op3_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import op3

    return op3(_table(spark, sf_dir, "documents"), tokenizer_file())


def op4_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import op4

    return op4(_table(spark, sf_dir, "documents"))


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import op5

    return op5(_table(spark, sf_dir, "documents"))


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import op6

    return op6(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import op7

    return op7(_table(spark, sf_dir, "documents"))


def op8_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import op8

    return op8(_table(spark, sf_dir, "documents"))


def op9_boosted_dom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import op9

    return op9(_table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import op10

    return op10(_table(spark, sf_dir, "documents"), tokenizer_file())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """Statements for those operators whose whole result SQL expresses."""
    from .oracles import REPEATS, RULES

    return {"op4_adaptive_rules": RULES, "op7_suffix_automata": REPEATS}
