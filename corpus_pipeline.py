"""A training-data pipeline of five stages; each takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs.

All stages read the five columns of documents, whatever others there are; an empty table gives an empty one. Rows without a
doc_id pass all stages but the decision on quality, and repeated rows are decided alike.
"""

from __future__ import annotations

import atexit
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declq.llm import bpe, decontamination, line_dedup, ngram_join, quality_mil
from declq.llm.common import ensure_checkpoint_dir, release, table, without_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under its threshold) go. A null text is scored as an empty one."""
    rows = quality_mil.score_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), output="rows")
    return rows.where("predicted = 1").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that repeat an earlier one; n_chars follows. All documents stay, null texts as they are (n_chars null)."""
    rows = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least doc_id with all of its rows; texts without words all stay."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none."""
    leaks = decontamination.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs.select(*COLUMNS), leaks.select("doc_id"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes; a null text is an empty one."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, output="digest")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicate_documents),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: Stages 1, 2 and 5 cannot be expressed in SQL (trained model, edit-distance groups, tokenizer); tests/llm/test_pipeline.py
#: holds run() against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session is gone, and with it the way to the folder
        _remove(spark, folder)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`; stages are written to the shared folder in between.

    A stage's files go when the next stage is written; the last ones, which the result reads, when the driver exits.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, folder)  # also where a stage fails
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            _remove(spark, before)
        before = at
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
