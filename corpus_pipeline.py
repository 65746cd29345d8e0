"""A corpus from documents to a mix, in five stages.

Each stage is a function of (spark, docs, sf_dir). All but the last return rows and columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from windrow.llm import decontaminate, language_id, ngram_join, quality, source_mix
from windrow.llm.shared import shared_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the quality classifier rejects; null and blank texts are among them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents without a letter and those for which no language reaches a score of 0.5."""
    return language_id.keep_known(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles and a similarity of 0.8."""
    return ngram_join.keep_one_of_each(docs, words=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return source_mix.mix_sources(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_copies", no_near_copies),
    ("decontaminate", no_benchmark),
    ("mix", mixed),
]

#: Classifiers and alignments are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written as Parquet in the shared folder before the next.

    A stage's folder is removed when the next one is written; the result reads the last.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    read = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if read:
            _remove(spark, read)
        read = f"{folder}/{name}"
        docs = spark.read.parquet(read)
    return STAGES[-1][1](spark, docs, sf_dir)
