"""Problem 2: transcripts into clean, ordered speaker turns.

Each transcript is read once (see transcript) into runs of speech; its time marks are repaired by
isotonic regression within file segments: marks() lists them, and a run's at_sec is the repaired mark
before it, from which turns() has the start of a turn.  Runs become turns in two steps, so that a
session with a third of all rows is no single task: inside a time bucket of a session by a window, and
over bucket borders by one summary row for each bucket (first and last speaker, number of turns).  The
texts of a turn stay rows (speech()), in order, for a monologue may be as long as a session.

Null and blank transcripts have no speech.  Speech before the first label is the own participant's;
a participant who is not on the roster speaks as NOBODY.  Ties of local_start_sec are ordered by
local_end_sec and atom_id.  Rows without a session or local_start_sec are in no session and give no
turn.  Rows delivered again count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.transcript import Fillers, Roster, repaired, repaired_segments, runs
from tidemark.plans.staging import spread, stage

BUCKET_SEC = 900
NOBODY = "SP99"
#: Reference tables are lists kept by hand; they travel inside the function only below this size.
REF_LIMIT = 50_000


def _bounded(df: DataFrame) -> list:
    rows = df.limit(REF_LIMIT + 1).collect()
    if len(rows) > REF_LIMIT:
        raise ValueError(f"a reference table of more than {REF_LIMIT} rows")
    return rows


def _spoken(atoms: DataFrame) -> DataFrame:
    one = atoms.select("session_id", "local_start_sec", "local_end_sec", "atom_id", "participant_source_id", "transcript").where(
        "session_id is not null and local_start_sec is not null and atom_id is not null and length(trim(transcript)) > 0"
    )
    return one.dropDuplicates(["atom_id"])


def _lists(roster: DataFrame, fillers: DataFrame) -> tuple[list, list]:
    people = [tuple(r) for r in _bounded(roster.select("speaker_id", "display_name", "participant_source_id", "aliases"))]
    return people, [r[0] for r in _bounded(fillers.select("filler"))]


def _end(start: float, end: float | None) -> float:
    return end if end is not None and end > start else start


def marks(atoms: DataFrame, roster: DataFrame, fillers: DataFrame) -> DataFrame:
    """atom_id, mark_no, stated_sec, segment_no, repaired_sec: the time marks of each transcript in their order, as written and as repaired."""
    people, sounds = _lists(roster, fillers)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, noise = Roster(people), Fillers(sounds)
        for batch in batches:
            rows = []
            for atom, start, end, transcript in zip(*(batch.column(i).to_pylist() for i in (3, 1, 2, 5))):
                stated = runs(transcript, names, noise)[1]
                rows += [(atom, n + 1, m, segment, t) for n, (m, (segment, t)) in enumerate(zip(stated, repaired_segments(stated, start, _end(start, end))))]
            types = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["atom_id", "mark_no", "stated_sec", "segment_no", "repaired_sec"])

    return spread(_spoken(atoms)).mapInArrow(read, "atom_id string, mark_no int, stated_sec double, segment_no int, repaired_sec double")


def speech_runs(atoms: DataFrame, roster: DataFrame, fillers: DataFrame) -> DataFrame:
    """session_id, start, until, atom_id, part, speaker_id, n_words, at_sec, text: the runs of each atom in order."""
    people, sounds = _lists(roster, fillers)
    one = _spoken(atoms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, noise = Roster(people), Fillers(sounds)
        for batch in batches:
            row, part, speaker, words, at, text = [], [], [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (1, 2, 4, 5)]
            for i, (start, end, participant, transcript) in enumerate(zip(*columns)):
                found, stated = runs(transcript, names, noise)
                if not found:
                    continue
                times = dict(zip(stated, repaired(stated, start, _end(start, end))))
                own = names.own.get(participant, NOBODY)
                # Runs of the own participant and of a label that names the same person are one run.
                last = None
                for run in found:
                    who = run.speaker or own
                    if who == last:
                        words[-1] += len(run.pieces)
                        text[-1] += " " + " ".join(run.pieces)
                        continue
                    last = who
                    row.append(i)
                    part.append(len(row))
                    speaker.append(who)
                    words.append(len(run.pieces))
                    at.append(times.get(run.at, start) if run.at is not None else start)
                    text.append(" ".join(run.pieces))
            where = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), batch.column(2).take(where), batch.column(3).take(where)]
                + [pa.array(part, pa.int32()), pa.array(speaker, pa.string()), pa.array(words, pa.int32()), pa.array(at, pa.float64()), pa.array(text, pa.string())],
                names=["session_id", "start", "until", "atom_id", "part", "speaker_id", "n_words", "at_sec", "text"],
            )

    return one.mapInArrow(read, "session_id string, start double, until double, atom_id string, part int, speaker_id string, n_words int, at_sec double, text string")


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs with bucket and the number of their turn in it, shift of each bucket); rows are staged, as they are read twice."""
    order = ["start", "until", "atom_id", "part"]
    inside = Window.partitionBy("session_id", "bucket").orderBy(*order)
    changes = F.when(F.lag("speaker_id").over(inside) == F.col("speaker_id"), 0).otherwise(1)
    numbered = rows.withColumn("change", changes).withColumn("local_no", F.sum("change").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("change")
    ends = numbered.groupBy("session_id", "bucket").agg(F.min_by("speaker_id", "local_no").alias("first"), F.max_by("speaker_id", "local_no").alias("last"), F.max("local_no").alias("n"))
    whole = Window.partitionBy("session_id").orderBy("bucket")
    joined = F.when(F.lag("last").over(whole) == F.col("first"), 1).otherwise(0)
    before = F.coalesce(F.sum(F.col("n") - F.col("joined")).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ends.withColumn("joined", joined).withColumn("shift", before - F.col("joined")).select("session_id", "bucket", "shift")
    return numbered, shifts


def _bucketed(runs_: DataFrame) -> DataFrame:
    return stage(runs_.withColumn("bucket", F.floor(F.col("start") / BUCKET_SEC)), "p2-runs")


def turns(atoms: DataFrame, roster: DataFrame, fillers: DataFrame) -> DataFrame:
    """session_id, turn_no, speaker_id, n_words, start_sec, end_sec: the turns of each session in order."""
    numbered, shifts = _placed(_bucketed(speech_runs(atoms, roster, fillers).drop("text")))
    local = numbered.groupBy("session_id", "bucket", "local_no").agg(
        F.first("speaker_id").alias("speaker_id"), F.sum("n_words").alias("n_words"), F.min("at_sec").alias("start_sec"), F.max(F.coalesce("until", "start")).alias("end_sec")
    )
    placed = local.join(shifts, ["session_id", "bucket"]).withColumn("turn_no", (F.col("shift") + F.col("local_no")).cast("int"))
    return placed.groupBy("session_id", "turn_no").agg(
        F.first("speaker_id").alias("speaker_id"), F.sum("n_words").cast("int").alias("n_words"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")
    )


def speech(atoms: DataFrame, roster: DataFrame, fillers: DataFrame) -> DataFrame:
    """session_id, turn_no, start, atom_id, part, speaker_id, at_sec, text: the clean speech of each turn.

    A row for each run of an atom; start, atom_id and part give the order inside a turn.
    """
    numbered, shifts = _placed(_bucketed(speech_runs(atoms, roster, fillers)))
    placed = numbered.join(shifts, ["session_id", "bucket"]).withColumn("turn_no", (F.col("shift") + F.col("local_no")).cast("int"))
    return placed.select("session_id", "turn_no", "start", "atom_id", "part", "speaker_id", "at_sec", "text")


def found(atoms: DataFrame, roster: DataFrame, fillers: DataFrame) -> DataFrame:
    """session_id, turn_no, speaker_id, n_words."""
    return turns(atoms, roster, fillers).select("session_id", "turn_no", "speaker_id", "n_words")
