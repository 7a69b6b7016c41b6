"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing. Each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, mixing, neardup, packing, quality, toxicity

STAGES = [
    ("quality", quality.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", neardup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The classifier and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus made from all documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
