"""The training-data pipeline: toxic documents go, then repeated lines, near copies and benchmark passages, then tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read
again before the next; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import bpe, lines, neardup, templates, toxicity
from memlake.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", lines.stage),
    ("MinHash near-dedup", neardup.stage),
    ("benchmark decontamination", templates.stage),
    ("byte-level BPE", bpe.stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the operators behind the stages against
#: brute force, a held-out sample or a round trip.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
