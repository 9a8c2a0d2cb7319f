"""A training-corpus pipeline over ``documents``; each stage works on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ramify.llm.queries import stage_benchmark, stage_exact, stage_language, stage_near, stage_tokens, table
from ramify.scratch import app_dir, remove

STAGES = [
    ("language_id", stage_language),
    ("exact_dedup", stage_exact),
    ("simhash_near_dedup", stage_near),
    ("benchmark_decontamination", stage_benchmark),
    ("byte_bpe", stage_tokens),
]

#: SQL cannot express language profiles, SimHash or BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and tokens of the documents that every stage keeps, a row each.

    Null and empty texts go in the first stage, as no language can be told of them. Rows that repeat
    an id and a text are copies like others: one stays. Null ids are kept like others and lose to
    any id within a group. An empty table gives an empty result; extra columns are carried up to the
    last stage and never clash with the operators' own, except those that begin with an underscore.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{app_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the stage has read is no longer needed, as its own table is whole
            remove(spark, before)
        before = path
    return docs
