"""From raw documents to packed token sequences, in five stages.

Each stage takes what the one before kept, as Parquet, and all but the last return the columns of documents:

1. language ID: documents without an identified language go;
2. n-gram Jaccard join: of near copies one document stays;
3. benchmark decontamination: documents that cover a benchmark item go;
4. PII: personal data in texts is masked;
5. packing: what is left is packed along a space-filling curve.

Defined cases: a null or empty text, or one without letters, has no language and goes in the first stage; nulls in any other column,
doc_id included, go along; of repeated rows and of equal texts the second stage keeps one, of documents in one group the one with
the smallest doc_id; texts of any length are read whole in every stage; an empty table, or an empty benchmark, passes through;
extra columns, whatever their names, are kept by the first four stages and ignored by the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.chosen_path import one_of_each
from gleanery.llm.common import staged
from gleanery.llm.hilbert_pack import pack_along_curve
from gleanery.llm.langid import identified_only
from gleanery.llm.tiling import decontaminated
from gleanery.llm.weak_pii import without_personal_data

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified_only(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_along_curve(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Models, hashing and tokenizers can't be written in SQL; tests/llm/test_pipeline.py checks each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
