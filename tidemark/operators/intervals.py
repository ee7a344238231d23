"""Interval operators: continuous periods and the gaps between them, and tolerance joins.

All times are whole milliseconds inside an entity; they are never compared across entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket: an entity with very many intervals is spread over its buckets.
BUCKET_MS = 3_600_000


def milliseconds(seconds: Column) -> Column:
    """Seconds (double) as whole milliseconds; null and NaN give null."""
    return F.when(~F.isnan(seconds), F.round(seconds * 1000).cast("bigint"))


def merged_pieces(intervals: DataFrame, key: str, start_ms: str, end_ms: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """key, bucket, piece_start, piece_end: intervals cut at bucket borders and merged within a bucket.

    Merging is Spark's own session window with a row-specific duration; partial sessions are merged
    before the shuffle where spark.sql.sessionWindow.merge.sessions.in.local.partition is set.
    Intervals with a null key or time, or with the end not after the start, do not count.
    """
    good = intervals.select(F.col(key).alias("key"), F.col(start_ms).alias("s"), F.col(end_ms).alias("e")).where("key is not null and s is not null and e > s")
    first, last = F.floor(F.col("s") / bucket_ms), F.floor((F.col("e") - 1) / bucket_ms)
    cut = good.withColumn("bucket", F.explode(F.sequence(first, last))).select(
        "key",
        "bucket",
        F.greatest("s", F.col("bucket") * bucket_ms).alias("s"),
        F.least("e", (F.col("bucket") + 1) * bucket_ms).alias("e"),
    )
    session = F.session_window(F.timestamp_millis("s"), F.make_interval(secs=((F.col("e") - F.col("s")) / 1000).cast("decimal(18,6)")))
    return cut.groupBy("key", "bucket", session.alias("w")).agg(F.min("s").alias("piece_start"), F.max("e").alias("piece_end")).drop("w")


def _with_neighbours(pieces: DataFrame) -> DataFrame:
    """pieces with previous_end and next_start, also over bucket borders.

    Windows run over one bucket of one entity; only a row per bucket takes part in the window over
    the whole entity.
    """
    inside = Window.partitionBy("key", "bucket").orderBy("piece_start")
    whole = Window.partitionBy("key").orderBy("bucket")
    local = pieces.withColumn("previous_end", F.lag("piece_end").over(inside)).withColumn("next_start", F.lead("piece_start").over(inside))
    ends = pieces.groupBy("key", "bucket").agg(F.min("piece_start").alias("first_start"), F.max("piece_end").alias("last_end"))
    around = ends.select("key", "bucket", F.lag("last_end").over(whole).alias("end_before"), F.lead("first_start").over(whole).alias("start_after"))
    return local.join(around, ["key", "bucket"]).select(
        "key", "bucket", "piece_start", "piece_end", F.coalesce("previous_end", "end_before").alias("previous_end"), F.coalesce("next_start", "start_after").alias("next_start")
    )


def gaps(intervals: DataFrame, key: str, start_ms: str, end_ms: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """key, gap_start_ms, gap_end_ms: the holes between consecutive continuous periods of an entity.

    Touching intervals are continuous.  An entity with one period, and an empty table, has no gap.
    """
    around = _with_neighbours(merged_pieces(intervals, key, start_ms, end_ms, bucket_ms))
    return around.where("next_start > piece_end").select(F.col("key").alias(key), F.col("piece_end").alias("gap_start_ms"), F.col("next_start").alias("gap_end_ms"))


def periods(intervals: DataFrame, key: str, start_ms: str, end_ms: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """key, period_no, start_ms, end_ms: the continuous periods of each entity, numbered from 1.

    A period begins at a piece that does not touch the one before and ends at a piece that does not
    touch the one after; the n-th begin belongs to the n-th end.
    """
    around = _with_neighbours(merged_pieces(intervals, key, start_ms, end_ms, bucket_ms))
    marks = around.select(
        "key",
        "bucket",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("previous_end").isNull() | (F.col("previous_end") < F.col("piece_start")), F.struct(F.lit("start").alias("kind"), F.col("piece_start").alias("at"))),
                    F.when(F.col("next_start").isNull() | (F.col("next_start") > F.col("piece_end")), F.struct(F.lit("end").alias("kind"), F.col("piece_end").alias("at"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("m"),
    ).select("key", "bucket", "m.kind", "m.at")
    before = Window.partitionBy("key", "kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marks.groupBy("key", "kind", "bucket").agg(F.count("*").alias("n")).select("key", "kind", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("key", "kind", "bucket").orderBy("at"))
    numbered = marks.withColumn("local_no", local).join(offsets, ["key", "kind", "bucket"]).withColumn("period_no", F.col("before") + F.col("local_no"))
    return (
        numbered.groupBy("key", "period_no")
        .agg(F.max(F.when(F.col("kind") == "start", F.col("at"))).alias("start_ms"), F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("end_ms"))
        .select(F.col("key").alias(key), F.col("period_no").cast("int").alias("period_no"), "start_ms", "end_ms")
    )
