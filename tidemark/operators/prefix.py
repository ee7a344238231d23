"""Running aggregates of keys of any size: inside range partitions by windows, across them by summary rows.

A window over a key is one task, however many rows the key has.  Here rows are range-partitioned by
(key, order), so a hot key lies in several partitions; each keeps its own window, and what the
partitions before it bring for the key is carried in from one row for each (key, partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

PART = "_part"


def ranged(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with the number of their range partition; written once, since borders are sampled."""
    return stage(rows.repartitionByRange(key, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def _same(key: str, carried: DataFrame, rows: DataFrame) -> DataFrame:
    named = carried.withColumnsRenamed({key: "_key", PART: "_of"})
    return rows.join(named, F.col(key).eqNullSafe(F.col("_key")) & (F.col(PART) == F.col("_of")), "left").drop("_key", "_of")


def _window(key: str, order: list[str], inclusive: bool) -> Window:
    return Window.partitionBy(key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def running_sum(rows: DataFrame, key: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """rows of ranged() with the sum of the key's amounts up to and with the row; null amounts count nothing."""
    before = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, PART).agg(F.sum(amount).alias("_all")).select(key, PART, F.sum("_all").over(before).alias("_in"))
    local = F.sum(amount).over(_window(key, order, True))
    both = _same(key, carried, rows.withColumn("_here", local))
    return both.withColumn(name, F.when(F.col("_in").isNull(), F.col("_here")).otherwise(F.col("_in") + F.coalesce("_here", F.lit(0)))).drop("_in", "_here")


def running_max(rows: DataFrame, key: str, order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """rows of ranged() with the largest of the key's values up to the row (with it, if inclusive)."""
    before = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, PART).agg(F.max(value).alias("_all")).select(key, PART, F.max("_all").over(before).alias("_in"))
    both = _same(key, carried, rows.withColumn("_here", F.max(value).over(_window(key, order, inclusive))))
    return both.withColumn(name, F.greatest("_here", "_in")).drop("_in", "_here")


def first_or_last(rows: DataFrame, key: str, order: list[str], value: Column, name: str, last: bool, inclusive: bool = True) -> DataFrame:
    """rows of ranged() with the first or the last non-null value of the key up to the row (with it, if inclusive)."""
    at = F.struct(*order)
    best = (F.max_by if last else F.min_by)(F.when(value.isNotNull(), value), F.when(value.isNotNull(), at))
    pick = F.last if last else F.first
    before = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, PART).agg(best.alias("_all")).select(key, PART, pick("_all", ignorenulls=True).over(before).alias("_in"))
    both = _same(key, carried, rows.withColumn("_here", pick(value, ignorenulls=True).over(_window(key, order, inclusive))))
    return both.withColumn(name, F.coalesce("_here", "_in") if last else F.coalesce("_in", "_here")).drop("_in", "_here")
