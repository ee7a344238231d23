"""Every query of the subpackage runs over whole tables; those with an SQL twin give the same rows."""

import pytest

from tests.oracle import connect, same
from tidemark.llm import queries as q

Q, O = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_same_as_sql(spark, data_dir, name):
    assert same(Q[name](spark, data_dir), connect(data_dir), O[name])


#: What must hold of the rows of each query without a twin, over whole tables; brute force is in the other modules.
HOLDS = {
    "p1_found": "atom_id_1 < atom_id_2 and field in ('dense_caption', 'transcript')",
    "p1_groups": "n_links >= 0 and group_id like concat(field, ':%')",
    "p2_found": "turn_no >= 1 and n_words >= 1",
    "p2_turns": "turn_no >= 1 and n_words >= 1 and start_sec <= end_sec",
    "p2_speech": "turn_no >= 1 and length(text) > 0",
    "p2_marks": "mark_no >= 1 and stated_sec >= 0 and repaired_sec is not null",
    "p4_found": "atom_id_1 < atom_id_2 and eval_split in ('dev', 'test')",
    "p4_report": "n_records >= 1 and n_overlaps >= n_records",
    "p4_coverage": "covered between 20 and n_chars and share <= 1",
    "p5_assignment": "new_split in ('train', 'dev', 'test')",
    "p7_found": "field in ('span', 'value') and clause_index >= 0",
    "p7_consistent": "kind in ('span', 'value', 'dense_caption')",
    "p7_groups": "n_forms >= 1 and n_texts >= n_forms",
    "p8_ids": "not exists(ids, x -> x < 0)",
    "p9_containers": "n_tokens between 1 and 2048 and offset = piece * 2048",
    "p9_report": "unused between 0 and 2 * 2048",
    "p10_found": "subject is not null",
    "p10_shares": "share between 0.05 and 1.000001 and n_sentences >= 3",
    "p10_functions": "accuracy between 0 and 1.000001 and n_votes > 0",
    "p10_composition": "n_documents > 0",
}


def test_every_query_has_a_rule():
    assert set(HOLDS) == set(Q) - set(O)


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_rows_hold(spark, data_dir, name):
    from pyspark.sql import functions as F

    df = Q[name](spark, data_dir)
    n = df.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.expr(HOLDS[name]), F.lit(False))).alias("bad")).first()
    assert n.n > 0 and n.bad == 0


def test_columns(spark, data_dir):
    want = {
        "p1_found": "field string, atom_id_1 string, atom_id_2 string",
        "p2_found": "session_id string, turn_no int, speaker_id string, n_words int",
        "p3_found": "segment_id string, atom_id string",
        "p4_found": "atom_id_1 string, atom_id_2 string, eval_split string",
        "p5_found": "source_group_id string",
        "p7_found": "cue_id string, clause_index int, field string",
        "p8_ids": "doc_id bigint, ids array<int>",
        "p10_found": "doc_id bigint, subject string",
    }
    for name, columns in want.items():
        assert ", ".join(f"{a} {b}" for a, b in Q[name](spark, data_dir).dtypes) == columns
