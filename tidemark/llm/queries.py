"""Queries of the llm subpackage, by name, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import p1_near_duplicates as p1
from tidemark.llm import p10_subjects as p10
from tidemark.llm import p2_speaker_turns as p2
from tidemark.llm import p3_nearest_time as p3
from tidemark.llm import p4_split_overlap as p4
from tidemark.llm import p5_group_split as p5
from tidemark.llm import p7_confusables as p7
from tidemark.llm import p8_encoding as p8
from tidemark.llm import p9_packing as p9
from tidemark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_P10 = ("documents", "subject_label", "subject_ref", "speaker_roster")


def queries() -> dict[str, Query]:
    """Name to query; each runs over its whole tables with production parameters."""
    return {
        "p1_found": lambda s, d: p1.found(table(s, d, "source_video_atom")),
        "p1_groups": lambda s, d: p1.groups(table(s, d, "source_video_atom")),
        "p2_found": lambda s, d: p2.found(*(table(s, d, t) for t in ("source_video_atom", "speaker_roster", "filler_ref"))),
        "p2_turns": lambda s, d: p2.turns(*(table(s, d, t) for t in ("source_video_atom", "speaker_roster", "filler_ref"))),
        "p2_speech": lambda s, d: p2.speech(*(table(s, d, t) for t in ("source_video_atom", "speaker_roster", "filler_ref"))),
        "p2_marks": lambda s, d: p2.marks(*(table(s, d, t) for t in ("source_video_atom", "speaker_roster", "filler_ref"))),
        "p3_found": lambda s, d: p3.found(table(s, d, "segments"), table(s, d, "source_video_atom")),
        "p3_matches": lambda s, d: p3.matches(table(s, d, "segments"), table(s, d, "source_video_atom")),
        "p4_found": lambda s, d: p4.found(table(s, d, "source_video_atom")),
        "p4_report": lambda s, d: p4.report(table(s, d, "source_video_atom")),
        "p4_coverage": lambda s, d: p4.coverage(table(s, d, "source_video_atom")),
        "p5_found": lambda s, d: p5.torn_groups(table(s, d, "source_video_atom")),
        "p5_assignment": lambda s, d: p5.assignment(table(s, d, "source_video_atom")),
        "p5_check": lambda s, d: p5.check(table(s, d, "source_video_atom")),
        "p7_found": lambda s, d: p7.found(table(s, d, "cue_v2"), table(s, d, "source_video_atom"), table(s, d, "cue_value_ref")),
        "p7_consistent": lambda s, d: p7.consistent(table(s, d, "cue_v2"), table(s, d, "source_video_atom")),
        "p7_groups": lambda s, d: p7.groups(table(s, d, "cue_v2"), table(s, d, "source_video_atom")),
        "p8_ids": lambda s, d: p8.encode(table(s, d, "documents")),
        "p8_decoded": lambda s, d: p8.decode(p8.encode(table(s, d, "documents"))),
        "p9_containers": lambda s, d: p9.containers(table(s, d, "documents")),
        "p9_report": lambda s, d: p9.report(table(s, d, "documents")),
        "p9_check": lambda s, d: p9.check(table(s, d, "documents")),
        "p10_found": lambda s, d: p10.found(*(table(s, d, t) for t in _P10)),
        "p10_shares": lambda s, d: p10.shares(*(table(s, d, t) for t in _P10)),
        "p10_functions": lambda s, d: p10.functions(*(table(s, d, t) for t in _P10)),
        "p10_composition": lambda s, d: p10.composition(*(table(s, d, t) for t in _P10)),
    }


def oracle_sql() -> dict[str, str]:
    """SQL twins; operators that SQL cannot express are tested in tests/llm instead."""
    return {"p3_found": p3.SQL, "p3_matches": p3.MATCHES_SQL, "p8_decoded": p8.DECODED_SQL, "p5_found": p5.FOUND_SQL, "p5_check": p5.CHECK_SQL, "p9_check": p9.CHECK_SQL}
