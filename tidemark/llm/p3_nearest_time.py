"""Problem 3: each record is paired with the nearest record in time of the same entity.

Both sides go to shards of WIDTH_MS of one entity, so a long session is spread over many shards; the
reference side is also put into the shards whose edge lies within the tolerance, so shard edges
overlap and a shard alone decides.  In a shard the reference times are sorted and a piecewise-linear
index is learned over them: a greedy cone fits segments whose predicted position is off by at most
ERROR places.  A record's time is predicted with its segment, and a local search in the window of
2 * ERROR + 3 places around the prediction gives the exact neighbours.

All times are whole milliseconds, doubled so that the middle of an interval stays whole.  Records
with a null entity or time are matched with none.  Of equally near references the earlier wins, then
the smaller id.  Rows delivered again count once.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import milliseconds

TOLERANCE_MS = 2_000
WIDTH_MS = 600_000
ERROR = 8


def learn(times: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first time, first position, slope) of the segments of a piecewise-linear index over sorted times.

    Within a segment the position of each of its times differs from the prediction by at most error.
    """
    firsts, places, slopes = [], [], []
    i, n, t = 0, len(times), times.tolist()
    while i < n:
        low, high, j = 0.0, float("inf"), i + 1
        while j < n:
            dx, dy = t[j] - t[i], j - i
            if dx == 0:
                if dy > error:
                    break
            else:
                a, b = (dy - error) / dx, (dy + error) / dx
                if a > high or b < low:
                    break
                low, high = max(low, a), min(high, b)
            j += 1
        firsts.append(t[i])
        places.append(i)
        slopes.append(low if high == float("inf") else (low + high) / 2)
        i = j
    return np.array(firsts, np.int64), np.array(places, np.int64), np.array(slopes)


def positions(times: np.ndarray, wanted: np.ndarray, error: int = ERROR) -> np.ndarray:
    """How many of the sorted times are smaller than each wanted time, by the learned index.

    The local search is exact where the true position lies in the predicted window, which its two
    ends show; times in a run of equals longer than the window, and those between two segments, are
    settled by bisection.
    """
    firsts, places, slopes = learn(times, error)
    n = len(times)
    segment = np.clip(np.searchsorted(firsts, wanted, side="right") - 1, 0, None)
    guess = places[segment] + slopes[segment] * (wanted - firsts[segment])
    last = np.append(places[1:], n)[segment]
    guess = np.clip(np.rint(guess), places[segment], last).astype(np.int64)
    window = guess[:, None] + np.arange(-error - 1, error + 2)[None, :]
    inside = (window >= 0) & (window < n)
    smaller = (times[np.clip(window, 0, n - 1)] < wanted[:, None]) & inside
    low = np.clip(window[:, 0], 0, n)
    out = low + smaller.sum(axis=1)
    high = np.clip(window[:, -1] + 1, 0, n)
    wrong = ((low > 0) & (times[np.clip(low - 1, 0, n - 1)] >= wanted)) | ((high < n) & (times[np.clip(high, 0, n - 1)] < wanted))
    if wrong.any():
        out[wrong] = np.searchsorted(times, wanted[wrong], side="left")
    return out


def _nearest(times: np.ndarray, wanted: np.ndarray, tolerance: int) -> np.ndarray:
    """Index of the nearest of the sorted times for each wanted time, or -1 beyond the tolerance."""
    if not len(times):
        return np.full(len(wanted), -1, np.int64)
    p = positions(times, wanted)
    left = np.clip(p - 1, 0, None)
    left = np.searchsorted(times, times[left], side="left")  # the smallest id among equal times
    right = np.clip(p, None, len(times) - 1)
    dl = np.where(p > 0, wanted - times[left], np.iinfo(np.int64).max)
    dr = np.where(p < len(times), times[right] - wanted, np.iinfo(np.int64).max)
    best = np.where(dl <= dr, left, right)
    return np.where(np.minimum(dl, dr) <= tolerance, best, -1)


def _shards(batches: Iterator[pa.RecordBatch], tolerance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (entity, shard, side, t, id): one output row for each record of side 1."""
    rest: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch | None:
        same = rows.column("entity").combine_chunks()
        if isinstance(same, pa.ChunkedArray):
            same = same.chunk(0)
        entity = same.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        shard = rows.column("shard").to_numpy()
        side, t = rows.column("side").to_numpy(), rows.column("t").to_numpy()
        ids = rows.column("id")
        cut = np.flatnonzero((entity[1:] != entity[:-1]) | (shard[1:] != shard[:-1])) + 1
        records, found = [], []
        for a, b in zip(np.append(0, cut), np.append(cut, len(t))):
            middle = a + int(np.searchsorted(side[a:b], 1))
            if middle == b:
                continue
            where = _nearest(t[a:middle], t[middle:b], tolerance)
            records.append(np.arange(middle, b))
            found.append(np.where(where < 0, -1, where + a))
        if not records:
            return None
        r, f = np.concatenate(records), np.concatenate(found)
        match = ids.take(pa.array(f, pa.int64(), mask=f < 0))
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids.take(pa.array(r)), match)], names=["id", "match"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        rows = pa.Table.from_batches(rest)
        last = rows.slice(rows.num_rows - 1).to_pylist()[0]
        # Complete shards go out; the last one may go on in the next batch.
        shard, entity = rows.column("shard"), rows.column("entity")
        open_rows = int(pc.sum(pc.and_(pc.equal(shard, last["shard"]), pc.equal(entity, last["entity"]))).as_py())
        whole = rows.num_rows - open_rows
        if whole:
            out = done(rows.slice(0, whole))
            if out is not None:
                yield out
            rest = rows.slice(whole).to_batches()
    if rest:
        out = done(pa.Table.from_batches(rest))
        if out is not None:
            yield out


def nearest(
    records: DataFrame,
    references: DataFrame,
    entity: str,
    record_id: str,
    reference_id: str,
    record_t: Column,
    reference_t: Column,
    tolerance_ms: int = TOLERANCE_MS,
    width_ms: int = WIDTH_MS,
) -> DataFrame:
    """record_id, reference_id (null where none is near enough), a row for each record.

    record_t, reference_t: twice the middle in milliseconds.
    """
    tolerance, width = 2 * tolerance_ms, 2 * width_ms
    a = references.select(F.col(entity).alias("entity"), F.col(reference_id).alias("id"), reference_t.cast("bigint").alias("t")).where("entity is not null and t is not null and id is not null")
    a = a.withColumn("shard", F.explode(F.sequence(F.floor((F.col("t") - tolerance) / width), F.floor((F.col("t") + tolerance) / width)))).withColumn("side", F.lit(0))
    b = records.select(F.col(entity).alias("entity"), F.col(record_id).alias("id"), record_t.cast("bigint").alias("t")).where("id is not null")
    dated = b.where("entity is not null and t is not null").withColumn("shard", F.floor(F.col("t") / width)).withColumn("side", F.lit(1))
    columns = ["entity", "shard", "side", "t", "id"]
    rows = a.select(columns).union(dated.select(columns)).repartition("entity", "shard").sortWithinPartitions(*columns)
    matched = rows.mapInArrow(lambda batches: _shards(batches, tolerance), "id string, match string")
    undated = b.where("entity is null or t is null").select("id", F.lit(None).cast("string").alias("match"))
    return matched.union(undated).distinct().select(F.col("id").alias(record_id), F.col("match").alias(reference_id))


def matches(segments: DataFrame, atoms: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """segment_id, atom_id (or null): the nearest spoken atom of each good transcript segment."""
    good = segments.where("modality = 'transcript' and parse_status = 'ok'")
    spoken = atoms.where(F.col("transcript").rlike(r"(?U)\S"))
    return nearest(
        good,
        spoken,
        "session_id",
        "segment_id",
        "atom_id",
        milliseconds(F.col("start_sec")) + milliseconds(F.col("end_sec")),
        milliseconds(F.col("local_start_sec")) + milliseconds(F.col("local_end_sec")),
        tolerance_ms,
    )


def found(segments: DataFrame, atoms: DataFrame) -> DataFrame:
    """segment_id, atom_id of the segments that have an atom within the tolerance."""
    return matches(segments, atoms).where("atom_id is not null")


#: The twin in SQL; SQL has no learned index, but the neighbours must be the same.
SQL = """
WITH a AS (SELECT DISTINCT atom_id, session_id, CAST(round(local_start_sec * 1000) AS BIGINT) + CAST(round(local_end_sec * 1000) AS BIGINT) AS t
           FROM source_video_atom WHERE regexp_matches(transcript, '[^\\s]')),
s AS (SELECT DISTINCT segment_id, session_id, CAST(round(start_sec * 1000) AS BIGINT) + CAST(round(end_sec * 1000) AS BIGINT) AS t
      FROM segments WHERE modality = 'transcript' AND parse_status = 'ok' AND start_sec IS NOT NULL AND end_sec IS NOT NULL),
p AS (SELECT s.segment_id, a.atom_id, row_number() OVER (PARTITION BY s.segment_id ORDER BY abs(a.t - s.t), a.t, a.atom_id) AS n
      FROM s JOIN a ON s.session_id = a.session_id AND abs(a.t - s.t) <= 4000)
SELECT segment_id, atom_id FROM p WHERE n = 1
"""
MATCHES_SQL = SQL.replace("SELECT segment_id, atom_id FROM p WHERE n = 1", "SELECT g.segment_id, p.atom_id FROM (SELECT DISTINCT segment_id FROM segments WHERE modality = 'transcript' AND parse_status = 'ok') g LEFT JOIN p ON p.segment_id = g.segment_id AND p.n = 1")
