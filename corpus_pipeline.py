"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, token ids.

Each stage takes the documents that the one before kept, written and read again as Parquet. All stages but the last return
their input's columns, whatever they are; an empty table stays empty; equal rows share their fate; a text of any length is
read whole. What happens to null texts and ids is said at each stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.llm import bpe, decontamination, line_dedup, ngram_join, quality
from loam.llm.common import discard, swept
from loam.llm.queries import TOKENIZER
from loam.session import ready, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. A null or empty text fails the base rules; a null id is judged like any other."""
    return quality.keep_good(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; no row goes, a null text stays null, a null id comes first."""
    return line_dedup.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8. Rows without words or id stay."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; rows without text stay, null items match nothing."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of ids and decoded text; a null text has none."""
    return bpe.encode_digests(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", token_stage),
]
#: Learned cutoffs, winnowing and the tokenizer have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage wrote on its way, and what the one before handed on, goes when its own rows are written."""
    docs, before = ready(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        at = f"{shared_folder(spark)}/loam/pipeline-{uuid.uuid4().hex}"
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(at), at
    return STAGES[-1][1](spark, docs, sf_dir)
