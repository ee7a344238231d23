"""The catalog: importing it registers the queries of all core modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import allocation_queries, audit_queries, event_queries, interval_queries, pipeline_queries, retrieval_queries, source_queries, validation_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES, Query, query
from tidemark.sources.tables import table


@query(
    "coverage_distribution",
    """SELECT lower(trim(modality_coverage)) AS coverage, count(DISTINCT atom_id) AS n_atoms
       FROM source_video_atom GROUP BY 1""",
)
def coverage_distribution(spark, d):
    """AG1: how many windows carry which modalities."""
    a = table(spark, d, "source_video_atom")
    return a.groupBy(F.lower(F.trim("modality_coverage")).alias("coverage")).agg(F.countDistinct("atom_id").alias("n_atoms"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
