"""All queries of the reference's own operators by their survey id, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.plans import composites, costs, curation, formats, intake, lookups, providers, reports, selection, settings, signals, stream, texts, writes  # noqa: F401  (they register their queries)
from gleanery.plans.catalog import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's flow: signals, blend, admission, utility, clusters, shortlist."""
    return curation.day_of(spark, sf_dir)["shortlist"]
