"""Tolerance interval join, its unmatched rest, and assembly of windows from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import modality_coverage, visible_text
from tidemark.functions.times import interval_gap

#: Width of the bands of the range join, in seconds.
BAND = 60.0


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float, start: str = "start_sec", end: str = "end_sec", band: float = BAND) -> DataFrame:
    """left and right rows of equal keys whose intervals lie at most `tolerance` apart.

    Both sides are put into the time bands that they touch (the left one widened by the tolerance)
    and joined on keys and band, so a key with very many rows is spread over its bands; the pair is
    kept in the first band that both are in.  Columns of left come as l_<name>, of right as r_<name>.
    Rows with a null key or time, or with the end before the start, meet nothing.
    """

    def side(df: DataFrame, prefix: str, wider: float) -> DataFrame:
        out = df.select([F.col(c).alias(f"{prefix}_{c}") for c in df.columns]).where(F.col(f"{prefix}_{start}") <= F.col(f"{prefix}_{end}"))
        first = F.floor((F.col(f"{prefix}_{start}") - wider) / band)
        last = F.floor((F.col(f"{prefix}_{end}") + wider) / band)
        return out.withColumn(f"{prefix}_first", first).withColumn("_band", F.explode(F.sequence(first, last)))

    a, b = side(left, "l", tolerance), side(right, "r", 0.0).withColumnRenamed("_band", "_band_r")
    same = (F.col("_band") == F.col("_band_r")) & (F.col("_band") == F.greatest("l_first", "r_first"))
    for k in keys:
        same &= F.col(f"l_{k}") == F.col(f"r_{k}")
    # Differences, not sums: the rounding at the border is part of the result.
    near = (F.col(f"l_{start}") - F.col(f"r_{end}") <= tolerance) & (F.col(f"r_{start}") - F.col(f"l_{end}") <= tolerance)
    return a.join(b, same & near).drop("_band", "_band_r", "l_first", "r_first")


def unmatched(right: DataFrame, joined: DataFrame, key: str) -> DataFrame:
    """Rows of right that are in no pair of an interval_join."""
    return right.join(joined.select(F.col(f"r_{key}").alias(key)).distinct(), key, "left_anti")


def windows(captions: DataFrame, transcripts: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """One window for each caption with the transcripts near it, and one for each transcript near none.

    Columns: keys, ordinal (from 1 in the order of the smallest start and segment id, then of its own times), start_sec,
    end_sec, transcript, dense_caption, visible_text, modality_coverage, transcript_segment_ids,
    dense_caption_segment_ids.  Inputs: keys, segment_id, start_sec, end_sec, text.
    """
    pairs = interval_join(captions, transcripts, keys, tolerance)
    part = F.struct(F.col("r_start_sec").alias("s"), F.col("r_end_sec").alias("e"), F.col("r_segment_id").alias("id"), F.col("r_text").alias("text"))
    attached = pairs.groupBy("l_segment_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    primary = captions.join(attached.withColumnRenamed("l_segment_id", "segment_id"), "segment_id", "left").select(
        *keys,
        "start_sec",
        "end_sec",
        F.least("start_sec", F.array_min(F.transform("parts", lambda p: p["s"]))).alias("_order"),
        F.least("segment_id", F.array_min(F.transform("parts", lambda p: p["id"]))).alias("_least"),
        F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("transcript"),
        F.col("text").alias("dense_caption"),
        F.coalesce(F.transform("parts", lambda p: p["id"]), F.array().cast("array<string>")).alias("transcript_segment_ids"),
        F.array("segment_id").alias("dense_caption_segment_ids"),
        F.col("segment_id").alias("_own"),
    )
    alone = unmatched(transcripts, pairs, "segment_id").select(
        *keys,
        "start_sec",
        "end_sec",
        F.col("start_sec").alias("_order"),
        F.col("segment_id").alias("_least"),
        F.col("text").alias("transcript"),
        F.lit(None).cast("string").alias("dense_caption"),
        F.array("segment_id").alias("transcript_segment_ids"),
        F.array().cast("array<string>").alias("dense_caption_segment_ids"),
        F.col("segment_id").alias("_own"),
    )
    every = primary.unionByName(alone)
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_order", "_least", "start_sec", "end_sec", "_own"))
    return every.select(
        *keys,
        order.alias("ordinal"),
        "start_sec",
        "end_sec",
        "transcript",
        "dense_caption",
        visible_text(F.col("transcript"), F.col("dense_caption")).alias("visible_text"),
        modality_coverage(F.col("transcript"), F.col("dense_caption")).alias("modality_coverage"),
        "transcript_segment_ids",
        "dense_caption_segment_ids",
    )


def gap(pair_prefixes: tuple[str, str] = ("l", "r")) -> Column:
    """Distance of the two intervals of a joined pair."""
    a, b = pair_prefixes
    return interval_gap(*(F.col(f"{p}_{c}") for p in (a, b) for c in ("start_sec", "end_sec")))
