"""Queries of problem 6: continuous periods of each session and the holes between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.intervals import gaps, milliseconds, periods
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_ISLANDS = """
WITH w AS (
  SELECT DISTINCT session_id, CAST(round(normalized_start_sec * 1000) AS BIGINT) AS s, CAST(round(normalized_end_sec * 1000) AS BIGINT) AS e
  FROM source_video_atom WHERE session_id IS NOT NULL AND NOT isnan(normalized_start_sec) AND NOT isnan(normalized_end_sec)),
m AS (
  SELECT session_id, s, e, max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM w WHERE e > s),
n AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS period_no FROM m)
"""


def _windows(spark, d):
    a = table(spark, d, "source_video_atom")
    return a.select("session_id", milliseconds(F.col("normalized_start_sec")).alias("s"), milliseconds(F.col("normalized_end_sec")).alias("e"))


@query("p6_found", _ISLANDS + "SELECT session_id, before AS gap_start_ms, s AS gap_end_ms FROM n WHERE s > before")
def p6_found(spark, d):
    """The holes between two consecutive continuous periods of a session."""
    return gaps(_windows(spark, d), "session_id", "s", "e")


@query("p6_periods", _ISLANDS + "SELECT session_id, CAST(period_no AS INTEGER) AS period_no, min(s) AS start_ms, max(e) AS end_ms FROM n GROUP BY session_id, period_no")
def p6_periods(spark, d):
    """The continuous periods of each session."""
    return periods(_windows(spark, d), "session_id", "s", "e")
