"""A training corpus from raw documents: each stage calls one operator of ``bruit.llm``.

Quality rules reject, repeated lines go, one document of each group of near
copies stays (five-word shingles, similarity of 0.8 or more), sources are mixed
to their target weights, and the mix is encoded.  ``run`` writes each stage's
result to the shared folder, so a lost executor never repeats more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bruit.llm import line_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from bruit.llm.common import new_path, remove, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.filter_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.filter_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.filter_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("source_mix", mix),
    ("sentencepiece", encode),
]

#: The rules' cutoffs need exact binomial bounds, and the last stage a tokenizer: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:  # this stage's input has no more readers
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
