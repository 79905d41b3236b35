"""A training corpus from documents in five stages, each an operator of strata.llm.

Every stage takes (spark, docs, sf_dir), works on all rows it gets, and returns
documents in the columns of its input; the last returns packed sequences. Each
stage's rows are written to the shared folder and reread by the next; spent ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import Scratch, release
from strata.llm.language import identify
from strata.llm.line_dedup import dedup_lines
from strata.llm.mixing import mix
from strata.llm.packing import pack_documents
from strata.llm.registry import tokenizer_path
from strata.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the four languages; what reads like none goes."""
    return identify(docs, declared=F.col("lang"), host=F.col("source")).where("__keep").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go; documents stay, with what is left of their text."""
    return dedup_lines(docs, as_documents=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (0.8 of the five-word shingles) stays."""
    return keep_one(docs, words_per_shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources weigh as the square root of their size; shuffled."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither fitted models nor groups of near copies nor packing; tests hold what each stage keeps against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        held = len(Scratch.live)
        docs = scratch.put(stage(spark, docs, sf_dir))
        release(held)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
