"""The corpus pipeline: quality, lines, near copies, mixture, tokens; each stage reads what the last one kept.

Stages take and return the columns of documents; the last one returns the documents that are left with
their token ids. Every stage writes its result and the next one reads it, so a lost executor costs one stage.
A stage begins by deleting what stages before it wrote on their way, unless its docs still read from there: a stage's
result has to be written before the next stage is called.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.byte_bpe import encoded_digests
from recollect.llm.line_dedup import without_repeated_lines
from recollect.llm.mixing import mixed
from recollect.llm.near_dedup import without_near_duplicates
from recollect.llm.quality import without_low_quality
from recollect.shared import clear, noting, written
from recollect.tables import table

#: No SQL: trained scores, signatures and token merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders with tables that stages wrote on their way.
_FOLDERS: list[str] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, _FOLDERS, docs)
        with noting(_FOLDERS):
            return f(spark, docs, sf_dir)

    return call


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    return without_low_quality(docs, table(spark, sf_dir, "labels"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occurred before."""
    return without_repeated_lines(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return without_near_duplicates(docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked probabilities."""
    return mixed(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and proof that they decode to the text."""
    return encoded_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).select(
        "doc_id", "source", "lang", F.col("token_ids"), "n_tokens", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("quality filter", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("byte BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
