"""Queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_files import token_file_round_trip
from .chosen_path import jaccard_join
from .hash_tree import shard_documents
from .hilbert_pack import pack_along_curve
from .langid import identify
from .license_join import oracle as license_oracle
from .license_join import scan_licenses
from .multi_index import search
from .ordinal import grade_documents
from .residual_pack import pack_documents
from .tiling import contaminated
from .token_align import align_corpus
from .turn_repair import damaged, repair_report
from .weak_pii import find_personal_data


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op3_word_first_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op4_string_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op10_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(_table(spark, sf_dir, "conversations")), F.col("times"))


QUERIES = (
    op1_hilbert_packing,
    op2_inverted_multi_index,
    op3_word_first_language_id,
    op4_string_tiling_decontamination,
    op5_license_set_join,
    op6_ordinal_quality,
    op7_hash_tree_sharding,
    op8_chosen_path_join,
    op9_weak_supervision_pii,
    op10_arrow_token_files,
    op11_residual_packing,
    op12_token_alignment,
    op13_turn_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_license_set_join": license_oracle()}
