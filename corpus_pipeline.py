"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm import stages
from lorebase.llm.common import read, staged

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_copies),
    ("ngram_jaccard_join", stages.drop_near_copies),
    ("mix_sources", stages.mix_sources),
    ("packing", stages.pack),
]

#: Scores, hash orders and packing can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
