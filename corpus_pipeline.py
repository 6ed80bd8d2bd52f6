"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the shared folder and read
again as the next stage's docs. All but the last return the columns of documents. Rows without a doc_id
or with one that repeats go by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probestack.llm import decontaminate, langid, mixing, near_dedup
from probestack.llm.shared import discard, read_table, scratch

STAGES = [
    ("language_id", langid.stage),
    ("minhash_near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("source_mixing", mixing.stage),
]

#: Neither the language model nor the signatures have a form in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # nothing reads it any more
    return docs
