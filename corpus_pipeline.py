"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its decisions take effect. All but the last
return the columns of documents; the last returns pieces of packed sequences. Documents that the mix takes
more than once are packed as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgraph.llm import linecrf, mixing, packing, partenum, quality
from kgraph.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linecrf.filter_lines(docs, linecrf.trained(docs, table(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # trained on labelled rows of the whole table: few low-quality documents are left after the rules
    return quality.filter_quality(docs, quality.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_join", ngram_join),
    ("mix_sources", mix),
    ("pack", pack),
]

#: SQL cannot express the trained stages; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
