"""Ledger-shaped operators: idempotent unions, running budgets, coverage, matching of two sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import PART, ranged, running_sum


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as JSON with nulls kept, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def idempotent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, n_rows, n_contents, conflict: a key delivered again must bring the same content."""
    h = df.select(key, F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("_h"))
    per = h.groupBy(key).agg(F.count("*").alias("n_rows"), F.min("_h").alias("lo"), F.max("_h").alias("hi"), F.countDistinct("_h").alias("n_contents"))
    return per.select(key, "n_rows", "n_contents", (F.col("lo") != F.col("hi")).alias("conflict"))


def running_budget(df: DataFrame, key: str, order: list[str], amount: str, cap: float, kind: str = "decimal(18,2)") -> DataFrame:
    """df with spent (running sum in order, which must be total) and stopped (the cap was passed before this row).

    A key with very many rows is several tasks, not one.
    """
    charge = F.col(amount).cast(kind)
    out = running_sum(ranged(df, key, order), key, order, charge, "spent").drop(PART)
    return out.withColumn("stopped", F.col("spent") - charge > F.lit(cap).cast(kind))


def usage_totals(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Sum of each column by group; null where any row lacks it."""
    total = [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in columns]
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *total)


def coverage(expected: DataFrame, key: str, outcomes: DataFrame, outcome: str, precedence: tuple[str, ...], missing: str = "missing") -> DataFrame:
    """key, outcome: every expected key with exactly one outcome, the first in precedence that it has."""
    rank = reduce(lambda acc, x: F.when(F.col(outcome) == x[1], x[0]).otherwise(acc), list(enumerate(precedence)), F.lit(len(precedence)))
    best = outcomes.groupBy(key).agg(F.min(rank).alias("_r"))
    names = F.array(*[F.lit(p) for p in (*precedence, missing)])
    return expected.select(key).distinct().join(best, key, "left").select(key, F.element_at(names, F.coalesce("_r", F.lit(len(precedence))) + 1).alias("outcome"))


def pending(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Expected keys that are not done yet: where a run goes on."""
    return expected.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def matched_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, n_left, n_right, status (both, only_left, only_right) by one full join of counts."""
    x = a.groupBy(key).agg(F.count("*").alias("n_left"))
    y = b.groupBy(key).agg(F.count("*").alias("n_right"))
    both = x.join(y, key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.withColumn("status", F.when(F.col("n_right") == 0, "only_left").when(F.col("n_left") == 0, "only_right").otherwise("both"))


def repairs(failures: DataFrame, key: str, attempt: str, last_attempt: int = 3) -> DataFrame:
    """key, next_attempt of the failed keys that may be tried once more."""
    return failures.groupBy(key).agg(F.max(attempt).alias("_a")).where(F.col("_a") < last_attempt).select(key, (F.col("_a") + 1).alias("next_attempt"))


def terminal_conflicts(df: DataFrame, key: str, outcome: str, terminal: tuple[str, ...]) -> DataFrame:
    """key, n_terminal: keys with other than one distinct terminal outcome."""
    per = df.groupBy(key).agg(F.countDistinct(F.when(F.col(outcome).isin(*terminal), F.col(outcome))).alias("n_terminal"))
    return per.where("n_terminal <> 1")
