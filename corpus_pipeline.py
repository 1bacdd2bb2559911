"""The corpus pipeline: five stages over ``documents``, each a training-data operator."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvet.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from tabvet.llm.common import drop_scratch, prepare, saved, scratch_mark, table

STAGES = [
    ("quality classifier", quality.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
]

#: SQL can't express the classifier; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    prepare(spark)
    docs, start = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        first = scratch_mark()
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        # The stage's result is written: what it was made of, the last stage's result too, isn't read again.
        drop_scratch(spark, first if first == start else first - 1, scratch_mark() - 1)
    return docs
