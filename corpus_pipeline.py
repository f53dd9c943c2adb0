"""The corpus pipeline: each stage is one operator, written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsmith.llm import decontaminate, packing, pii, simhash, toxicity
from oddsmith.llm.common import materialize, table
from oddsmith.llm.queries import SURROGATE_KEY, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below one half; null, empty and repeated texts are judged like any other, an empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of five-word shingle sets that are 0.8 alike, null and blank texts being one class; ties keep the least id."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a ten-word window of the benchmark; null and wordless texts stay, an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced in their texts; null and empty texts stay as they are, equal texts stay equal."""
    return pii.replace_personal_data(docs, SURROGATE_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a text; null and empty texts are their end token alone, repeated rows are packed each, other columns go."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii_surrogates", replace_personal_data),
    ("packing", pack),
]
ORACLE_SQL = None  # no stage can be written in SQL; tests/llm/test_pipeline.py replays it by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, which may be empty; a column of another name goes through all but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
