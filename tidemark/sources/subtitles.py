"""Subtitle files: discovery, path metadata, block parsing with errors as rows, rendering."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import collapse
from tidemark.functions.times import RANGE, clock_seconds


def safe_identifier(c: Column) -> Column:
    """Runs of other than ASCII letters and digits to one underscore, none at the ends; 'unknown' if nothing is left."""
    squeezed = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(squeezed, F.lit("")), F.lit("unknown"))


def path_metadata(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """df with participant_source_id, source_day, file_name, session_uid, session_id, path_status from the path.

    The path is <modality>/<participant>/.../DAYn/.../<file>.srt; the first DAY1 to DAY7 below the
    participant counts.  A path that does not fit has the status inventory_error and null fields.
    """
    rest = F.regexp_extract(path, r"^[^/]+/(.+)$", 1)
    participant = F.regexp_extract(rest, r"^([^/]+)/", 1)
    day = F.regexp_extract(rest, r"(?i)^[^/]+/(?:[^/]+/)*?(DAY[1-7])/", 1)
    below = F.regexp_extract(rest, r"(?i)^[^/]+/(?:[^/]+/)*?DAY[1-7]/(.+)$", 1)
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(below, r"\.[^./]*$", "")
    # The word of the modality may stand at either end or in the middle of the file name.
    plain = F.regexp_replace(stem, r"(?i)(^|[_\-\s/])(transcript|dense[_\-\s]?caption)($|[_\-\s])", "$1_$3")
    good = (participant != "") & (day != "") & F.lower(name).endswith(".srt")
    uid = F.when(good, safe_identifier(plain))
    return df.withColumns(
        {
            "participant_source_id": F.when(good, participant),
            "source_day": F.when(good, F.upper(day)),
            "file_name": name,
            "session_uid": uid,
            "session_id": F.when(good, F.concat_ws("_", F.lit("ses"), safe_identifier(participant), F.upper(day), uid)),
            "path_status": F.when(good, "discovered").otherwise("inventory_error"),
        }
    )


def discover(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """modality, relative_path, file_size_bytes and path metadata of all *.srt files below the roots.

    The letter case of the suffix does not matter.  A root that is not there has no files.
    """
    out = None
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    for modality, root in roots.items():
        where = hadoop.fs.Path(root)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            continue
        scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        # The scan leaves out files without a byte; the index that it made on the driver has them.
        listed = spark.createDataFrame([(unquote(p),) for p in scan.inputFiles()], "path string")
        sized = scan.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")
        listed = listed.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
        files = listed.join(sized, "path", "left").select(F.regexp_replace("path", "^file:///", "file:/").alias("path"), F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))
        base = root.rstrip("/").rpartition("/")[0]
        relative = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
        part = files.where(F.lower("path").endswith(".srt")).select(F.lit(modality).alias("modality"), relative.alias("relative_path"), F.col("length").alias("file_size_bytes"), "path")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "modality string, relative_path string, file_size_bytes bigint, path string")
    return counterpart(path_metadata(out))


def counterpart(inventory: DataFrame) -> DataFrame:
    """inventory with has_counterpart: the session has files of more than one modality."""
    per = inventory.groupBy("participant_source_id", "source_day", "session_uid").agg((F.size(F.collect_set("modality")) > 1).alias("has_counterpart"))
    keys = ["participant_source_id", "source_day", "session_uid"]
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    joined = inventory.drop("has_counterpart").alias("i").join(per.alias("p"), same[0] & same[1] & same[2], "left")
    return joined.select("i.*", (F.coalesce("p.has_counterpart", F.lit(False)) & F.col("i.session_uid").isNotNull()).alias("has_counterpart"))


def blocks(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """keep, srt_block_index, lines: the non-empty blocks of subtitle texts; empty ones count in the index."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), "^﻿+", ""), "\\z", "")
    split = files.select(*keep, F.posexplode(F.split(text, "\n[\t ]*\n+")).alias("pos", "block"))
    lines = F.transform(F.split("block", "\n"), lambda x: F.trim(x))
    return split.select(*keep, (F.col("pos") + 1).alias("srt_block_index"), lines.alias("lines")).where(F.exists("lines", lambda x: x != ""))


def parse(files: DataFrame, keep: list[str], file_key: str = "relative_path", content: str = "content") -> DataFrame:
    """keep, srt_block_index, parse_status, error, start_sec, end_sec, raw_text, text: a row for each block.

    The words of status and error are fixed values.  Status: ok, error (missing_or_invalid_timecode, non_positive_duration), discarded_empty,
    discarded_duplicate_adjacent (same text as the last kept or empty block of the file).  A file
    without any block gives one error row, no_srt_blocks, with the index 0.
    """
    cut = blocks(files, keep, content)
    at = F.expr(f"array_position(transform(lines, x -> x rlike '{RANGE.replace(chr(92), chr(92) * 2)}'), true)").cast("int")
    timed = cut.withColumn("at", at).withColumn("time", F.when(F.col("at") > 0, F.element_at("lines", F.col("at"))))
    start, end = clock_seconds(F.col("time")), clock_seconds(F.col("time"), first=5)
    raw = F.trim(F.array_join(F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0))), "\n"))
    fields = timed.withColumn("start_sec", start).withColumn("end_sec", end).withColumn("raw_text", F.when(F.col("at") > 0, raw))
    rough = fields.withColumn("text", collapse("raw_text")).withColumn(
        "error",
        F.when(F.col("at") == 0, "missing_or_invalid_timecode").when(F.col("end_sec") <= F.col("start_sec"), "non_positive_duration").when(F.col("text") == "", "empty_text"),
    )
    # Dropped rows repeat the text before them, so they need not be skipped; error rows do.
    bad = F.coalesce(F.col("error").isin("missing_or_invalid_timecode", "non_positive_duration"), F.lit(False))
    before = F.lag("text").over(Window.partitionBy(file_key, bad).orderBy("srt_block_index"))
    judged = rough.withColumn("repeated", ~bad & F.col("error").isNull() & F.coalesce(before == F.col("text"), F.lit(False)))
    status = F.when(bad, "error").when(F.col("error") == "empty_text", "discarded_empty").when(F.col("repeated"), "discarded_duplicate_adjacent").otherwise("ok")
    ok, kept = status == "ok", status.isin("ok", "discarded_duplicate_adjacent")
    rows = judged.select(
        *keep,
        "srt_block_index",
        status.alias("parse_status"),
        F.when(F.col("repeated"), "duplicate_adjacent_text").otherwise(F.col("error")).alias("error"),
        F.when(ok, F.col("start_sec")).alias("start_sec"),
        F.when(ok, F.col("end_sec")).alias("end_sec"),
        F.when(kept, F.col("raw_text")).alias("raw_text"),
        F.when(kept, F.col("text")).alias("text"),
    )
    empty = files.join(cut.select(file_key).distinct(), file_key, "left_anti").select(
        *keep, F.lit(0).alias("srt_block_index"), F.lit("error").alias("parse_status"), F.lit("no_srt_blocks").alias("error"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("start_sec", "double"), ("end_sec", "double"), ("raw_text", "string"), ("text", "string"))),
    )
    return rows.unionByName(empty)


def segment_id(modality: Column, participant: Column, day: Column, uid: Column, path: Column, index: Column) -> Column:
    """FIXED VALUES, the form of an id: tr_ or dc_, the session, ten digits of the path's SHA-256 and the block index in six places."""
    short = F.when(modality == "transcript", "tr").otherwise("dc")
    return F.concat_ws("_", short, participant, day, uid, F.substring(F.sha2(path, 256), 1, 10), F.lpad(index.cast("string"), 6, "0"))


def clock_text(seconds: Column) -> Column:
    """Seconds as HH:MM:SS,mmm."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)


def render(segments: DataFrame, file_key: str = "relative_path") -> DataFrame:
    """file_key, content: subtitle text of the segments of each file in the order of their index."""
    block = F.concat(F.col("srt_block_index").cast("string"), F.lit("\n"), clock_text(F.col("start_sec")), F.lit(" --> "), clock_text(F.col("end_sec")), F.lit("\n"), F.col("text"))
    parts = segments.groupBy(file_key).agg(F.sort_array(F.collect_list(F.struct("srt_block_index", block.alias("b")))).alias("parts"))
    return parts.select(file_key, F.array_join(F.transform("parts", lambda p: p["b"]), "\n\n").alias("content"))
