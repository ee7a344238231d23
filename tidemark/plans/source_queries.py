"""Queries of the source build: paths, parsing, alignment, report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.align import gap, interval_join, unmatched, windows
from tidemark.plans.registry import query
from tidemark.sources import subtitles
from tidemark.sources.tables import table

KEYS = ["participant_source_id", "source_day", "session_id"]

#: Good segments once each.
_OK = """seg AS (SELECT DISTINCT segment_id, modality, participant_source_id, source_day, session_id, start_sec, end_sec, text
  FROM segments WHERE parse_status = 'ok' AND start_sec IS NOT NULL AND end_sec IS NOT NULL),
d AS (SELECT * FROM seg WHERE modality = 'dense_caption'), t AS (SELECT * FROM seg WHERE modality = 'transcript'),
p AS (SELECT d.segment_id AS d_id, t.segment_id AS t_id, t.start_sec AS ts, t.end_sec AS te, t.text AS tt, d.start_sec AS ds, d.end_sec AS de
  FROM d JOIN t USING (participant_source_id, source_day, session_id) WHERE d.start_sec - t.end_sec <= 2.0 AND t.start_sec - d.end_sec <= 2.0)"""


def _segments(spark, d, modality=None):
    rows = table(spark, d, "segments").where("parse_status = 'ok' and start_sec is not null and end_sec is not null")
    if modality:
        rows = rows.where(F.col("modality") == modality)
    return rows.select("segment_id", "modality", *KEYS, "start_sec", "end_sec", "text").dropDuplicates(["segment_id"])


def _pairs(spark, d):
    return interval_join(_segments(spark, d, "dense_caption").drop("modality"), _segments(spark, d, "transcript").drop("modality"), KEYS, 2.0)


@query(
    "inventory_paths",
    """SELECT relative_path, regexp_extract(relative_path, '^[^/]+/([^/]+)/', 1) AS participant_source_id,
         upper(regexp_extract(relative_path, '/(DAY[1-7])/', 1, 'i')) AS source_day, regexp_extract(relative_path, '([^/]+)$', 1) AS file_name,
         trim(regexp_replace(regexp_replace(regexp_extract(relative_path, '/DAY[1-7]/(.+)\\.[^./]*$', 1, 'i'), '(^|[_\\-\\s/])(transcript|dense[_\\-\\s]?caption)($|[_\\-\\s])', '\\1_\\3', 'i'), '[^A-Za-z0-9]+', '_', 'g'), '_') AS session_uid
       FROM (SELECT DISTINCT relative_path FROM inventory WHERE relative_path IS NOT NULL)""",
)
def inventory_paths(spark, d):
    """SRC2: participant, day, file name and session uid from each path."""
    paths = table(spark, d, "inventory").select("relative_path").where("relative_path is not null").distinct()
    return subtitles.path_metadata(paths).select("relative_path", "participant_source_id", "source_day", "file_name", "session_uid")


@query(
    "counterpart_flag",
    """WITH i AS (SELECT DISTINCT modality, participant_source_id, source_day, session_uid, relative_path FROM inventory),
       p AS (SELECT participant_source_id, source_day, session_uid, count(DISTINCT modality) > 1 AS has_counterpart FROM i GROUP BY 1, 2, 3)
       SELECT i.modality, i.participant_source_id, i.source_day, i.relative_path, coalesce(p.has_counterpart, false) AS has_counterpart
       FROM i LEFT JOIN p USING (participant_source_id, source_day, session_uid)""",
)
def counterpart_flag(spark, d):
    """SRC3: does a session have files of more than one modality."""
    i = table(spark, d, "inventory").select("modality", "participant_source_id", "source_day", "session_uid", "relative_path").distinct()
    return subtitles.counterpart(i).drop("session_uid")


@query(
    "subtitle_round_trip",
    """WITH s AS (SELECT DISTINCT relative_path, srt_block_index, start_sec, end_sec, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM segments
         WHERE parse_status = 'ok' AND start_sec >= 0 AND end_sec > start_sec AND regexp_matches(text, '\\S')),
       n AS (SELECT *, CAST(row_number() OVER (PARTITION BY relative_path ORDER BY srt_block_index) AS INTEGER) AS n,
         lag(text) OVER (PARTITION BY relative_path ORDER BY srt_block_index) AS before FROM s)
       SELECT relative_path, n AS srt_block_index, CASE WHEN text = before THEN 'discarded_duplicate_adjacent' ELSE 'ok' END AS parse_status,
         CASE WHEN text IS DISTINCT FROM before THEN start_sec END AS start_sec, CASE WHEN text IS DISTINCT FROM before THEN end_sec END AS end_sec, text FROM n""",
)
def subtitle_round_trip(spark, d):
    """PRJ1-6: segments written as subtitle files and parsed again."""
    s = table(spark, d, "segments").where("parse_status = 'ok' and start_sec >= 0 and end_sec > start_sec").select("relative_path", "srt_block_index", "start_sec", "end_sec", "text").where(F.col("text").rlike(r"\S")).distinct()
    files = subtitles.render(s)
    return subtitles.parse(files, ["relative_path"]).select("relative_path", "srt_block_index", "parse_status", "start_sec", "end_sec", "text")


@query(
    "adjacent_dedup",
    """WITH s AS (SELECT DISTINCT segment_id, relative_path, srt_block_index, text FROM segments WHERE parse_status <> 'error' AND text IS NOT NULL)
       SELECT segment_id, coalesce(text = lag(text) OVER (PARTITION BY relative_path ORDER BY srt_block_index, segment_id), false) AS repeated FROM s""",
)
def adjacent_dedup(spark, d):
    """PRJ4, WN2: blocks that repeat the text of the block before them."""
    s = table(spark, d, "segments").where("parse_status <> 'error' and text is not null").select("segment_id", "relative_path", "srt_block_index", "text").distinct()
    before = F.lag("text").over(Window.partitionBy("relative_path").orderBy("srt_block_index", "segment_id"))
    return s.select("segment_id", F.coalesce(F.col("text") == before, F.lit(False)).alias("repeated"))


@query(
    "segment_ids",
    """SELECT DISTINCT relative_path, srt_block_index, concat_ws('_', CASE modality WHEN 'transcript' THEN 'tr' ELSE 'dc' END, participant_source_id, source_day, session_uid,
         substr(sha256(relative_path), 1, 10), lpad(CAST(srt_block_index AS VARCHAR), 6, '0')) AS made_id FROM segments""",
)
def segment_ids(spark, d):
    """PRJ5: deterministic ids of blocks."""
    made = subtitles.segment_id(*(F.col(c) for c in ("modality", "participant_source_id", "source_day", "session_uid", "relative_path", "srt_block_index")))
    return table(spark, d, "segments").select("relative_path", "srt_block_index", made.alias("made_id")).distinct()


@query("interval_align", f"WITH {_OK} SELECT d_id AS caption_id, t_id AS transcript_id, greatest(0.0, ds - te, ts - de) AS gap_sec FROM p")
def interval_align(spark, d):
    """JN1, PRJ14: captions and the transcripts at most two seconds away."""
    return _pairs(spark, d).select(F.col("l_segment_id").alias("caption_id"), F.col("r_segment_id").alias("transcript_id"), gap().alias("gap_sec"))


@query("interval_unmatched", f"WITH {_OK} SELECT segment_id FROM t WHERE segment_id NOT IN (SELECT t_id FROM p)")
def interval_unmatched(spark, d):
    """JN2: transcripts near no caption."""
    return unmatched(_segments(spark, d, "transcript"), _pairs(spark, d), "segment_id").select("segment_id")


_WINDOWS = f"""WITH {_OK},
g AS (SELECT d_id, string_agg(tt, ' ' ORDER BY ts, te, t_id) AS transcript, min(ts) AS s, min(t_id) AS i, count(*) AS n FROM p GROUP BY d_id),
a AS (SELECT d.*, g.transcript, least(d.start_sec, g.s) AS o, least(d.segment_id, g.i) AS m, coalesce(g.n, 0) AS n_tr FROM d LEFT JOIN g ON d.segment_id = g.d_id),
u AS (SELECT participant_source_id, source_day, session_id, start_sec, end_sec, transcript, text AS dense_caption, o, m, segment_id AS own, n_tr, 1 AS n_dc FROM a
  UNION ALL SELECT participant_source_id, source_day, session_id, start_sec, end_sec, text, NULL, start_sec, segment_id, segment_id, 1, 0 FROM t WHERE segment_id NOT IN (SELECT t_id FROM p)),
w AS (SELECT *, nullif(trim(transcript), '') AS tr, nullif(trim(dense_caption), '') AS dc FROM u)
SELECT participant_source_id, source_day, session_id, CAST(row_number() OVER (PARTITION BY participant_source_id, source_day, session_id ORDER BY o, m, start_sec, end_sec, own) AS INTEGER) AS ordinal,
  start_sec, end_sec, CAST(n_tr AS INTEGER) AS n_transcripts, n_dc AS n_captions,
  CASE WHEN tr IS NOT NULL AND dc IS NOT NULL THEN 'Dense caption: ' || dc || chr(10) || 'Transcript: ' || tr ELSE coalesce(dc, tr, '') END AS visible_text,
  CASE WHEN tr IS NOT NULL AND dc IS NOT NULL THEN 'both' WHEN tr IS NOT NULL THEN 'transcript_only' WHEN dc IS NOT NULL THEN 'dense_caption_only' ELSE 'none' END AS modality_coverage FROM w"""


def _windows(spark, d):
    return windows(_segments(spark, d, "dense_caption").drop("modality"), _segments(spark, d, "transcript").drop("modality"), KEYS)


@query("aligned_windows", _WINDOWS)
def aligned_windows(spark, d):
    """JN1-3, PRJ15, WN1: windows of captions with their transcripts, and of transcripts alone."""
    w = _windows(spark, d)
    return w.select(*KEYS, "ordinal", "start_sec", "end_sec", F.size("transcript_segment_ids").alias("n_transcripts"), F.size("dense_caption_segment_ids").alias("n_captions"), "visible_text", "modality_coverage")


@query(
    "pairing_rate",
    f"""WITH x AS ({_WINDOWS}) SELECT count(*) AS n_windows, count(*) FILTER (n_captions = 1) AS n_captions, count(*) FILTER (modality_coverage = 'both') AS n_both,
        coalesce(round(count(*) FILTER (modality_coverage = 'both') / nullif(count(*) FILTER (n_captions = 1), 0), 6), 0) AS pairing_rate,
        coalesce(round(count(*) FILTER (modality_coverage LIKE '%_only') / nullif(count(*), 0), 6), 0) AS single_modality_ratio FROM x""",
)
def pairing_rate(spark, d):
    """AG3: how many captions have a transcript, how many windows only one modality."""
    w = _windows(spark, d)
    n, dc = F.count("*"), F.count_if(F.size("dense_caption_segment_ids") == 1)
    both, single = F.count_if(F.col("modality_coverage") == "both"), F.count_if(F.col("modality_coverage").endswith("_only"))
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 6), F.lit(0.0))
    return w.agg(n.alias("n_windows"), dc.alias("n_captions"), both.alias("n_both"), rate(both, dc).alias("pairing_rate"), rate(single, n).alias("single_modality_ratio"))


_ATOMS = "(SELECT DISTINCT atom_id, participant_source_id, modality_coverage, local_start_sec, local_end_sec FROM source_video_atom)"


def _atoms(spark, d):
    return table(spark, d, "source_video_atom").select("atom_id", "participant_source_id", "modality_coverage", "local_start_sec", "local_end_sec").dropDuplicates(["atom_id"])


@query(
    "duration_summary",
    f"""SELECT participant_source_id, count(*) AS n, round(sum(local_end_sec - local_start_sec), 6) AS total, round(min(local_end_sec - local_start_sec), 6) AS minimum,
        round(max(local_end_sec - local_start_sec), 6) AS maximum, round(avg(local_end_sec - local_start_sec), 6) AS mean FROM {_ATOMS} GROUP BY 1""",
)
def duration_summary(spark, d):
    """AG2: count, total, extremes and mean of window lengths by participant."""
    length = F.col("local_end_sec") - F.col("local_start_sec")
    cols = {"total": F.sum(length), "minimum": F.min(length), "maximum": F.max(length), "mean": F.avg(length)}
    return _atoms(spark, d).groupBy("participant_source_id").agg(F.count("*").alias("n"), *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(k) for k, c in cols.items()))


@query("duration_anomalies", f"SELECT atom_id, local_end_sec - local_start_sec AS length_sec FROM {_ATOMS} WHERE local_end_sec - local_start_sec > 30")
def duration_anomalies(spark, d):
    """FLT6: windows longer than thirty seconds."""
    return _atoms(spark, d).select("atom_id", (F.col("local_end_sec") - F.col("local_start_sec")).alias("length_sec")).where("length_sec > 30")


@query("segment_status", "SELECT modality, parse_status, coalesce(error, '') AS error, count(DISTINCT segment_id) AS n FROM segments GROUP BY ALL")
def segment_status(spark, d):
    """PRJ3, AG1: blocks by what became of them."""
    return table(spark, d, "segments").groupBy("modality", "parse_status", F.coalesce("error", F.lit("")).alias("error")).agg(F.countDistinct("segment_id").alias("n"))
