"""The corpus pipeline: good documents, without repeated lines, near-duplicates and benchmark passages, mixed to weights.

Every stage reads doc_id, text, lang, source and n_chars of its predecessor's table and drops other columns, whatever their
names. Null and empty texts are documents like any other: the classifier scores them, they hold no line, no passage and no
word, and their fingerprint is zero, so one of them stays. Rows with a null id and repeated rows are rows of their own until
the near-dedup, where one of each group stays. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm import decontaminate, linededup, mixing, quality, simhash
from dyadic.llm.common import table
from dyadic.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later repeated runs go, and with them documents that had nothing else."""
    made = linededup.drop_repeated_lines(docs)
    kept = made.filter("n_removed < n_lines or n_removed = 0")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.keep_one(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: how many words of each document the mix takes, repeats counted."""
    return mixing.taken_words(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near),
    ("benchmark decontamination", drop_leaks),
    ("source mix", mix),
]

# The classifier's and SimHash's decisions have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
