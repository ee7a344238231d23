"""Distribution statistics in single passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distributions(df: DataFrame, columns: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """dimension, value, n (and extra aggregates): the distributions of several columns in one pass.

    Grouping sets expand each row once for each column and combine before the shuffle.
    """
    named = df.select(*[F.col(c).cast("string").alias(c) for c in columns], *[c for c in df.columns if c not in columns])
    grouped = named.groupingSets([[F.col(c)] for c in columns], *columns)
    more = [c.alias(k) for k, c in (extra or {}).items()]
    out = grouped.agg(F.count("*").alias("n"), F.grouping_id().alias("_g"), *more)
    # In a grouping id the bit of the column that is grouped by is 0.
    n = len(columns)
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        mask = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        dimension = F.when(F.col("_g") == mask, c).otherwise(dimension)
        value = F.when(F.col("_g") == mask, F.col(c)).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "n", *(extra or {}))


def quantile_summary(df: DataFrame, column: str) -> DataFrame:
    """n, minimum, median, p95, p99, maximum of a column, exactly."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    one = df.agg(F.count(column).alias("n"), F.min(column).alias("minimum"), p.alias("p"), F.max(column).alias("maximum"))
    return one.select("n", "minimum", F.get("p", 0).alias("median"), F.get("p", 1).alias("p95"), F.get("p", 2).alias("p99"), "maximum")


def occupancy(df: DataFrame, column: str) -> DataFrame:
    """n_values, n_rows, largest_share, entropy of the distribution of a column."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    sums = counts.agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows"), F.max("n").alias("_m"), F.sum(F.col("n") * F.log("n")).alias("_s"))
    # -sum p ln p with p = n / N is ln N - sum(n ln n) / N.
    return sums.select("n_values", "n_rows", (F.col("_m") / F.col("n_rows")).alias("largest_share"), (F.log("n_rows") - F.col("_s") / F.col("n_rows")).alias("entropy"))


def card(title: str, row: dict) -> str:
    """A short Markdown card of one row of figures."""
    return "\n".join([f"# {title}", "", "| figure | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in row.items()], ""])
