"""A corpus pipeline over documents: quality rules, line dedup, near duplicates, decontamination, token ids.

Each stage is a function of (spark, docs, sf_dir) on all that the one before kept.  Line
dedup and near duplicates write what they found and delete their intermediate tables.
run() writes every stage's result to the shared folder and reads it again, so a stage
has no lineage beyond its input and a lost executor repeats little; then it deletes what
the stage left there besides.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.llm import bpe, decontam, line_dedup, ngram_join, quality
from loomline.llm.exchange import landed, scratch, shared_dir


_USED = ("doc_id", "text", "source")


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with its other columns renamed, so that none has a name that an operator adds; and the columns as they were."""
    own = {c: f"__own__{c}" for c in docs.columns if c not in _USED}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    safe, columns = _apart(docs)
    return quality.judge(safe).where("kept").select(*columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that match earlier ones; those left without any word go.

    n_chars, if there is one, is counted anew.
    """
    path = shared_dir(spark)
    with scratch(spark):
        left = line_dedup.dedup(docs).where(F.col("text").rlike("[^ \\t-\\r]"))
        if "n_chars" in docs.columns:
            left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return landed(left.select(*docs.columns), path)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates; rows that repeat an id and its text are one."""
    path = shared_dir(spark)
    with scratch(spark):
        return landed(ngram_join.firsts(docs), path)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by the benchmark's passages."""
    safe, columns = _apart(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.mark(safe, benchmark).where(~decontam.contaminated()).select(*columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of every document's ids and of what they decode to."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", token_ids),
]

#: SQL can't express byte-level BPE; the pipeline is tested against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):
            docs = landed(stage(spark, docs, sf_dir), path)
    return docs
