"""Queries of evidence, validation, ledgers and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import evidence as E
from tidemark.operators import ledger as L
from tidemark.operators import statistics as S
from tidemark.operators import validate as V
from tidemark.operators.prefix import first_or_last, ranged, running_max
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_CLAUSES = """q AS (SELECT DISTINCT cue_id, atom_id, predicate FROM cue_v2 WHERE predicate IS NOT NULL),
k AS (SELECT cue_id, atom_id, unnest(range(len(predicate.all_of)))::INTEGER AS clause_index, unnest(predicate.all_of) AS c FROM q),
cl AS (SELECT DISTINCT cue_id, atom_id, clause_index, c.dimension AS dimension, c.operator AS operator, c.value AS value, c.evidence.field AS field, c.evidence.span AS span FROM k)"""
_TEXTS = "a AS (SELECT DISTINCT atom_id, transcript, dense_caption, visible_text FROM source_video_atom)"


def _texts(spark, d):
    return table(spark, d, "source_video_atom").select("atom_id", "transcript", "dense_caption", "visible_text").dropDuplicates(["atom_id"])


@query(
    "predicate_fail",
    f"""WITH {_CLAUSES}, {_TEXTS}, h AS (SELECT atom_id, trim(regexp_replace(lower(concat_ws(' ', coalesce(transcript, ''), coalesce(dense_caption, ''), coalesce(visible_text, ''))), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS hay FROM a),
        j AS (SELECT cue_id, clause_index, coalesce(trim(regexp_replace(lower(value), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) <> '' AND contains(hay, trim(regexp_replace(lower(value), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), false) AS there,
          operator IN ('eq', 'present', 'starts', 'ends', 'contains') AS wants FROM cl JOIN h USING (atom_id))
        SELECT cue_id, count(*) AS n_clauses, count(*) FILTER (there <> wants) AS n_failed FROM j GROUP BY 1""",
)
def predicate_fail(spark, d):
    """FLT2: clauses of each cue that do not hold in its window's texts."""
    cl = E.exploded(table(spark, d, "cue_v2"))
    hay = X.lower_collapse(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("transcript", "dense_caption", "visible_text")]))
    j = cl.join(_texts(spark, d).select("atom_id", hay.alias("hay")), "atom_id")
    failed = F.size(E.unsatisfied(F.array(F.struct("operator", "value")), F.col("hay")))
    return j.withColumn("f", failed).groupBy("cue_id").agg(F.count("*").alias("n_clauses"), F.sum("f").alias("n_failed"))


@query(
    "cue_grounding",
    f"""WITH {_CLAUSES}, {_TEXTS}, j AS (SELECT cl.*, CASE field WHEN 'transcript' THEN transcript WHEN 'dense_caption' THEN dense_caption END AS own, CASE field WHEN 'transcript' THEN dense_caption WHEN 'dense_caption' THEN transcript END AS other FROM cl JOIN a USING (atom_id)),
        i AS (SELECT *, coalesce(span <> '' AND contains(own, span), false) AS in_own, coalesce(span <> '' AND contains(other, span), false) AS in_other,
          coalesce(trim(value) <> '' AND contains(trim(span), trim(value)) AND lower(trim(value)) NOT IN ('null', 'none', 'unknown', 'n/a', 'na', 'nil', '无', '未知'), false) AS good FROM j)
        SELECT cue_id, clause_index, CASE WHEN field IS NULL OR field NOT IN ('transcript', 'dense_caption') THEN 'CROSS_FIELD_EVIDENCE' WHEN NOT in_own AND in_other THEN 'CROSS_FIELD_EVIDENCE' WHEN NOT in_own THEN 'SPAN_NOT_CONTIGUOUS'
          WHEN NOT good THEN 'VALUE_NOT_SUPPORTED' ELSE 'grounded' END AS code FROM i""",
)
def cue_grounding(spark, d):
    """DM1, VL4: the first rule of grounding that each clause breaks."""
    j = E.exploded(table(spark, d, "cue_v2")).join(_texts(spark, d).drop("visible_text"), "atom_id")
    code = E.grounding_code(*[F.col(c) for c in ("field", "span", "value", "transcript", "dense_caption")])
    return j.select("cue_id", "clause_index", F.coalesce(code, F.lit("grounded")).alias("code"))


@query(
    "cue_status",
    f"""WITH {_CLAUSES}, v AS (SELECT cl.*, r.value_id IS NOT NULL AS listed FROM cl LEFT JOIN cue_value_ref r ON r.dimension = cl.dimension AND r.cue_value = cl.value)
        SELECT c.cue_id, c.disposition, count(v.clause_index) AS n_clauses, count(*) FILTER (v.listed) AS n_listed FROM (SELECT DISTINCT cue_id, disposition FROM cue_v2) c LEFT JOIN v USING (cue_id) GROUP BY 1, 2""",
)
def cue_status(spark, d):
    """DM1-2, JN5: cues with their clauses looked up in the list of values."""
    cues = table(spark, d, "cue_v2").select("cue_id", "disposition").distinct()
    ref = table(spark, d, "cue_value_ref").select(F.col("dimension").alias("rd"), F.col("cue_value").alias("rv"), F.lit(True).alias("listed"))
    cl = E.exploded(table(spark, d, "cue_v2"))
    v = cl.join(ref, (F.col("dimension") == F.col("rd")) & (F.col("value") == F.col("rv")), "left").select("cue_id", "clause_index", "listed")
    return cues.join(v, "cue_id", "left").groupBy("cue_id", "disposition").agg(F.count("clause_index").alias("n_clauses"), F.count_if(F.coalesce("listed", F.lit(False))).alias("n_listed"))


@query("compact_expansion", f"WITH {_CLAUSES} SELECT cue_id, clause_index AS n, field, span, 'ok' AS status FROM cl WHERE field IS NOT NULL")
def compact_expansion(spark, d):
    """DM2-3, PRJ24: clauses packed into compact answers and expanded again."""
    cl = E.exploded(table(spark, d, "cue_v2")).where("field is not null")
    code = F.when(F.col("field") == "transcript", "t").otherwise("d")
    item = F.struct(F.col("clause_index").alias("n"), code.alias("f"), F.col("span").alias("x"), F.array(F.array("dimension", "operator", "value")).alias("p"), F.lit(90).alias("c"))
    answers = cl.groupBy("cue_id").agg(F.to_json(F.collect_list(item)).alias("body"))
    return E.expand_compact(answers, "cue_id", "body", {"t": "transcript", "d": "dense_caption"}).select("cue_id", "n", "field", "span", "status")


@query("normal_forms")
def normal_forms(spark, d):
    """PRJ6-11: every caption and transcript in the normal forms that SQL lacks."""
    a = _texts(spark, d).select("atom_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("dense_caption", "transcript")))).alias("x")).select("atom_id", "x.field", "x.text").where("text is not null")
    return a.select("atom_id", "field", X.nfkc_casefold("text").alias("folded"), X.nfkc_tidy("text").alias("tidy"), X.evidence_normal("text").alias("evidence"), X.eligibility_form("text").alias("eligible"), X.collapse("text").alias("collapsed"), X.has_letter_or_digit("text").alias("has_content"))


@query(
    "collapsed_forms",
    "SELECT DISTINCT atom_id, trim(regexp_replace(transcript, '\\s+', ' ', 'g')) AS collapsed, regexp_matches(transcript, '[\\p{L}\\p{N}]') AS has_content FROM source_video_atom WHERE transcript IS NOT NULL AND regexp_full_match(transcript, '[ -~\\n\\t]*')",
)
def collapsed_forms(spark, d):
    """PRJ6: white space of the plain ASCII transcripts collapsed, the part of the normal forms that SQL has."""
    a = table(spark, d, "source_video_atom").select("atom_id", "transcript").distinct().where(F.col("transcript").rlike(r"^[ -~\n\t]*$"))
    return a.select("atom_id", X.collapse("transcript").alias("collapsed"), X.has_letter_or_digit("transcript").alias("has_content"))


@query("evidence_spans")
def evidence_spans(spark, d):
    """PRJ10: where a span stands in the text that it names, after normalising, as the text writes it."""
    cl = E.exploded(table(spark, d, "cue_v2")).where("field in ('dense_caption', 'transcript')").join(_texts(spark, d).select("atom_id", "dense_caption", "transcript"), "atom_id")
    own = F.when(F.col("field") == "transcript", F.col("transcript")).otherwise(F.col("dense_caption"))
    return cl.select("cue_id", "clause_index", X.evidence_span(own, "span").alias("slice"))


@query(
    "passages",
    """SELECT DISTINCT atom_id, sha256(concat_ws(chr(10), CASE WHEN transcript <> '' THEN 'transcript: ' || transcript END, CASE WHEN dense_caption <> '' THEN 'dense_caption: ' || dense_caption END)) AS passage_sha,
         regexp_replace(atom_id, '^src_', 'cue_') AS cue_id FROM source_video_atom""",
)
def passages(spark, d):
    """PRJ16-18, PRJ22: serialised passages by their hash, and derived ids."""
    line = lambda c: F.when(F.col(c) != "", F.concat(F.lit(f"{c}: "), F.col(c)))
    passage = F.concat_ws("\n", line("transcript"), line("dense_caption"))
    return _texts(spark, d).select("atom_id", F.sha2(passage, 256).alias("passage_sha"), F.regexp_replace("atom_id", "^src_", "cue_").alias("cue_id"))


@query(
    "last_clock",
    """SELECT atom_id, list_max(list_transform(regexp_extract_all(transcript, '\\d{2}:\\d{2}:\\d{2}'), lambda x: substr(x, 1, 2)::INTEGER * 3600 + substr(x, 4, 2)::INTEGER * 60 + substr(x, 7, 2)::INTEGER)) AS last_sec
       FROM (SELECT DISTINCT atom_id, transcript FROM source_video_atom WHERE regexp_matches(transcript, '\\d{2}:\\d{2}:\\d{2}'))""",
)
def last_clock(spark, d):
    """PRJ27: the latest clock in each text."""
    clocks = F.regexp_extract_all("transcript", F.lit(r"(\d{2}:\d{2}:\d{2})"))
    sec = F.transform(clocks, lambda x: F.substring(x, 1, 2).cast("int") * 3600 + F.substring(x, 4, 2).cast("int") * 60 + F.substring(x, 7, 2).cast("int"))
    return _texts(spark, d).where(F.col("transcript").rlike(r"\d{2}:\d{2}:\d{2}")).select("atom_id", F.array_max(sec).alias("last_sec"))


@query("forbidden_keys", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_exists(props, '$.k')")
def forbidden_keys(spark, d):
    """PRJ25: rows whose JSON has a key that it must not have."""
    e = table(spark, d, "events").select("event_id", "props")
    return e.where(F.array_contains(F.json_object_keys("props"), "k")).select("event_id", F.get_json_object("props", "$.k").alias("k"))


_ISSUE = "'blocker' AS severity"


@query("unique_violations", f"SELECT {_ISSUE}, 'duplicate_key' AS issue_type, cue_id AS failure_id, '1' AS expected, CAST(count(*) AS VARCHAR) AS actual FROM cue_v2 GROUP BY cue_id HAVING count(*) > 1")
def unique_violations(spark, d):
    """VL2, ST3: cue ids that were delivered more than once."""
    return V.unique(table(spark, d, "cue_v2"), "cue_id")


@query(
    "fk_missing",
    f"SELECT DISTINCT {_ISSUE}, 'missing_parent' AS issue_type, session_id AS failure_id, 'session_id exists' AS expected, 'missing' AS actual FROM segments WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM source_video_atom WHERE session_id IS NOT NULL)",
)
def fk_missing(spark, d):
    """VL5, JN5: sessions of segments that no window has."""
    return V.foreign_key(table(spark, d, "segments"), "session_id", table(spark, d, "source_video_atom"), "session_id")


@query(
    "fd_violations",
    f"""SELECT {_ISSUE}, 'not_functional' AS issue_type, source_group_id AS failure_id, 'one value' AS expected, min(lower(trim(split))) || ' .. ' || max(lower(trim(split))) AS actual
        FROM source_video_atom WHERE source_group_id IS NOT NULL GROUP BY source_group_id HAVING min(lower(trim(split))) < max(lower(trim(split)))""",
)
def fd_violations(spark, d):
    """VL3, AG7: groups with windows in more than one split."""
    a = table(spark, d, "source_video_atom").where("source_group_id is not null").withColumn("split", F.lower(F.trim("split")))
    return V.functional(a, "source_group_id", "split")


@query(
    "row_checks",
    f"""WITH a AS (SELECT DISTINCT * EXCLUDE (received_at, source_srt_paths, transcript_segment_ids, dense_caption_segment_ids) FROM source_video_atom),
        r AS (SELECT atom_id, unnest(['atom_id_pattern', 'day_domain', 'end_after_start', 'normalized_order', 'coverage_domain']) AS issue_type,
          unnest([regexp_full_match(atom_id, 'src_[A-Za-z0-9_]+'), source_day IN ('DAY1', 'DAY2', 'DAY3', 'DAY4', 'DAY5', 'DAY6', 'DAY7'), local_end_sec > local_start_sec, normalized_end_sec > normalized_start_sec,
            modality_coverage IN ('both', 'transcript_only', 'dense_caption_only')]) AS ok FROM a)
        SELECT {_ISSUE}, issue_type, atom_id AS failure_id, 'holds' AS expected, 'fails' AS actual FROM r WHERE NOT coalesce(ok, false)""",
)
def row_checks(spark, d):
    """VL1, VL3, VL11: patterns, domains and order of each window's fields."""
    a = table(spark, d, "source_video_atom").dropDuplicates(["atom_id"])
    rules = {
        "atom_id_pattern": F.col("atom_id").rlike("^src_[A-Za-z0-9_]+$"),
        "day_domain": F.col("source_day").isin(*[f"DAY{i}" for i in range(1, 8)]),
        "end_after_start": F.col("local_end_sec") > F.col("local_start_sec"),
        "normalized_order": F.col("normalized_end_sec") > F.col("normalized_start_sec"),
        "coverage_domain": F.col("modality_coverage").isin("both", "transcript_only", "dense_caption_only"),
    }
    return V.checks(a, "atom_id", rules)


@query(
    "monotonicity",
    f"""WITH w AS (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
        SELECT {_ISSUE}, 'not_monotonic' AS issue_type, count(*) AS n FROM w WHERE o_totalprice < before""",
)
def monotonicity(spark, d):
    """VL6, SO5, WN2: values that fall in the order of their key."""
    return V.monotonic(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").groupBy("severity", "issue_type").agg(F.count("*").alias("n"))


@query(
    "contiguity",
    f"""SELECT {_ISSUE}, 'not_contiguous' AS issue_type, CAST(relative_path AS VARCHAR) AS failure_id, '1..' || count(*) AS expected, min(srt_block_index) || '..' || max(srt_block_index) AS actual
        FROM (SELECT DISTINCT relative_path, segment_id, srt_block_index FROM segments) GROUP BY relative_path HAVING min(srt_block_index) <> 1 OR max(srt_block_index) <> count(*) OR count(DISTINCT srt_block_index) <> count(*)""",
)
def contiguity(spark, d):
    """VL6, VL15: files whose block numbers have gaps."""
    s = table(spark, d, "segments").select("relative_path", "segment_id", "srt_block_index").distinct()
    return V.contiguous(s, "relative_path", "srt_block_index", 1)


@query(
    "set_equality",
    f"""WITH a AS (SELECT DISTINCT session_id AS k FROM segments), b AS (SELECT DISTINCT session_id AS k FROM inventory WHERE session_id IS NOT NULL)
        SELECT {_ISSUE}, 'only_left' AS issue_type, k AS failure_id, 'in both' AS expected, 'left' AS actual FROM a WHERE k NOT IN (SELECT k FROM b)
        UNION ALL SELECT {_ISSUE}, 'only_right', k, 'in both', 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""",
)
def set_equality(spark, d):
    """ST2, JN11, VL19, VL24: sessions that only one table has."""
    return V.same_set(table(spark, d, "segments").where("session_id is not null"), table(spark, d, "inventory").where("session_id is not null"), "session_id")


@query(
    "bijection",
    f"""WITH p AS (SELECT DISTINCT session_id, session_uid FROM inventory)
        SELECT {_ISSUE}, 'many_session_uid' AS issue_type, session_id AS failure_id, '1' AS expected, CAST(count(*) AS VARCHAR) AS actual FROM p GROUP BY session_id HAVING count(*) > 1
        UNION ALL SELECT {_ISSUE}, 'many_session_id', session_uid, '1', CAST(count(*) AS VARCHAR) FROM p GROUP BY session_uid HAVING count(*) > 1""",
)
def bijection(spark, d):
    """VL15, JN10: ids that are not one to one."""
    return V.bijection(table(spark, d, "inventory"), "session_id", "session_uid")


# FIXED VALUES: fields that must not stand in what a model sees; ids of the inside.
MARKERS = ("gold_action", "event_role", "rule_id", "intention_state_before", "intention_state_after", "oracle_annotation")
INSIDE = r"\b(int|rule)_[A-Za-z0-9_]+\b"


@query(
    "leakage",
    f"""WITH a AS (SELECT DISTINCT atom_id, visible_text || CASE WHEN CAST(floor(local_start_sec) AS BIGINT) % 17 = 0 THEN ' Gold_Action' ELSE '' END || CASE WHEN CAST(floor(local_start_sec) AS BIGINT) % 19 = 0 THEN ' see rule_Ab_9.' ELSE '' END AS t FROM source_video_atom WHERE visible_text IS NOT NULL),
        m AS (SELECT atom_id, unnest({list(MARKERS)!r}) AS m, t FROM a)
        SELECT {_ISSUE}, 'leakage' AS issue_type, atom_id AS failure_id, 'absent' AS expected, m AS actual FROM m WHERE contains(lower(t), m) UNION ALL SELECT {_ISSUE}, 'leakage', atom_id, 'absent', 'inner id' FROM a WHERE regexp_matches(t, '{INSIDE}')""",
)
def leakage(spark, d):
    """VL8: texts that show a field or an id of the inside; both are planted in some of them."""
    a = table(spark, d, "source_video_atom").where("visible_text is not null").select("atom_id", "visible_text", F.floor("local_start_sec").alias("sec")).dropDuplicates(["atom_id"])
    text = F.concat("visible_text", F.when(F.col("sec") % 17 == 0, " Gold_Action").otherwise(""), F.when(F.col("sec") % 19 == 0, " see rule_Ab_9.").otherwise(""))
    return V.leaks(a.select("atom_id", text.alias("t")), "atom_id", "t", list(MARKERS), {"inner id": INSIDE})


@query(
    "truth_table",
    f"""SELECT {_ISSUE}, 'combination' AS issue_type, segment_id AS failure_id, 'allowed' AS expected, parse_status || '/' || coalesce(error, 'null') AS actual
        FROM (SELECT DISTINCT segment_id, parse_status, error FROM segments) WHERE NOT ((parse_status = 'ok' AND error IS NULL) OR (parse_status = 'error' AND coalesce(error, '') = 'non_positive_duration'))""",
)
def truth_table(spark, d):
    """VL17, VL20: combinations of status and error that are not in the table."""
    allowed = spark.createDataFrame([("ok", None), ("error", "non_positive_duration")], "parse_status string, error string")
    return V.truth_table(table(spark, d, "segments").select("segment_id", "parse_status", "error").distinct(), "segment_id", ["parse_status", "error"], allowed)


@query(
    "sum_mismatch",
    """WITH s AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) SELECT count(*) AS n_bad FROM (SELECT o_orderkey AS k, o_totalprice AS t FROM orders) o FULL JOIN s USING (k) WHERE abs(coalesce(s, 0) - coalesce(t, 0)) > 1000""",
)
def sum_mismatch(spark, d):
    """VL16, VL22: totals that their parts do not add up to."""
    return V.sums_match(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k"), "k", "l_extendedprice", table(spark, d, "orders").withColumnRenamed("o_orderkey", "k"), "o_totalprice", 1000.0).agg(F.count("*").alias("n_bad"))


@query("issue_rollup", """SELECT 'duplicate_key' AS issue_type, 'blocker' AS severity, count(*) AS n FROM (SELECT 1 FROM cue_v2 GROUP BY cue_id HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_key_atoms', 'blocker', count(*) FROM (SELECT 1 FROM source_video_atom GROUP BY atom_id HAVING count(*) > 1)""")
def issue_rollup(spark, d):
    """AG10, VL10: issues of several checks by kind."""
    atoms = V.unique(table(spark, d, "source_video_atom"), "atom_id").withColumn("issue_type", F.lit("duplicate_key_atoms"))
    return V.rolled_up(V.every(V.unique(table(spark, d, "cue_v2"), "cue_id"), atoms))


@query("idempotent_union", "SELECT cue_id, count(*) AS n_rows, count(DISTINCT (atom_id, item_index, disposition, run_id)) AS n_contents, count(DISTINCT (atom_id, item_index, disposition, run_id)) > 1 AS conflict FROM cue_v2 GROUP BY 1")
def idempotent_union(spark, d):
    """ST4, LG2-3: rows delivered again must bring the same content."""
    return L.idempotent(table(spark, d, "cue_v2"), "cue_id", ["atom_id", "item_index", "disposition", "run_id"])


@query(
    "ledger_budget",
    """SELECT o_orderkey, o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS spent, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w - CAST(o_totalprice AS DECIMAL(18,2)) > 500000 AS stopped
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""",
)
def ledger_budget(spark, d):
    """WN5: running charges and the rows behind the cap."""
    return L.running_budget(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 500000).select("o_orderkey", "o_custkey", "spent", "stopped")


@query(
    "usage_totals",
    "SELECT source, count(*) AS n_rows, CASE WHEN count(n_chars) = count(*) THEN CAST(sum(n_chars) AS BIGINT) END AS n_chars FROM documents GROUP BY 1",
)
def usage_totals(spark, d):
    """AG8: totals that are null where any row lacks the value."""
    return L.usage_totals(table(spark, d, "documents"), ["source"], ["n_chars"])


@query(
    "coverage_closure",
    """WITH c AS (SELECT atom_id, min(CASE disposition WHEN 'accepted_cue' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'no_cue' THEN 2 ELSE 3 END) AS r FROM cue_v2 GROUP BY 1)
       SELECT a.atom_id, CASE coalesce(c.r, 3) WHEN 0 THEN 'accepted_cue' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'no_cue' ELSE 'missing' END AS outcome FROM (SELECT DISTINCT atom_id FROM source_video_atom) a LEFT JOIN c USING (atom_id)""",
)
def coverage_closure(spark, d):
    """LG4: every window with exactly one outcome."""
    return L.coverage(table(spark, d, "source_video_atom"), "atom_id", table(spark, d, "cue_v2"), "disposition", ("accepted_cue", "ambiguous", "no_cue"))


@query("outcome_counts", "SELECT disposition, count(DISTINCT cue_id) AS n FROM cue_v2 GROUP BY 1")
def outcome_counts(spark, d):
    """AG12: cues by disposition."""
    return table(spark, d, "cue_v2").groupBy("disposition").agg(F.countDistinct("cue_id").alias("n"))


@query("pending_work", "SELECT DISTINCT atom_id FROM source_video_atom WHERE atom_id NOT IN (SELECT atom_id FROM cue_v2)")
def pending_work(spark, d):
    """SS7: windows that no cue was inferred for yet."""
    return L.pending(table(spark, d, "source_video_atom"), table(spark, d, "cue_v2"), "atom_id")


@query(
    "matched_sides",
    """WITH a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM subject_label GROUP BY 1)
       SELECT doc_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN b.n IS NULL THEN 'only_left' WHEN a.n IS NULL THEN 'only_right' ELSE 'both' END AS status FROM a FULL JOIN b USING (doc_id)""",
)
def matched_sides(spark, d):
    """JN9-10: documents and labels, each side's counts and what lacks."""
    return L.matched_sides(table(spark, d, "documents"), table(spark, d, "subject_label"), "doc_id")


@query("repair_candidates", "SELECT l_orderkey, max(l_linenumber) + 1 AS next_attempt FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING max(l_linenumber) < 3")
def repair_candidates(spark, d):
    """LG9: failed keys that may be tried once more."""
    return L.repairs(table(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey", "l_linenumber")


@query("terminal_conflicts", "SELECT l_orderkey, count(DISTINCT CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag END) AS n_terminal FROM lineitem GROUP BY 1 HAVING n_terminal <> 1")
def terminal_conflicts(spark, d):
    """LG2, VL17, VL23: keys without exactly one terminal outcome."""
    return L.terminal_conflicts(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ("A", "R"))


_ONE = "(SELECT DISTINCT atom_id, lower(trim(split)) AS split, participant_source_id AS participant, modality_coverage AS coverage, local_end_sec - local_start_sec AS sec FROM source_video_atom)"


@query(
    "dataset_statistics",
    f"""WITH g AS (SELECT split, participant, coverage, grouping(split) AS gs, grouping(participant) AS gp, count(*) AS n, round(sum(sec), 3) AS seconds FROM {_ONE} GROUP BY GROUPING SETS ((split), (participant), (coverage)))
        SELECT CASE WHEN gs = 0 THEN 'split' WHEN gp = 0 THEN 'participant' ELSE 'coverage' END AS dimension, CASE WHEN gs = 0 THEN split WHEN gp = 0 THEN participant ELSE coverage END AS value, n, seconds FROM g""",
)
def dataset_statistics(spark, d):
    """AG1, AG4: several distributions in one pass over distinct windows."""
    a = table(spark, d, "source_video_atom").select("atom_id", F.lower(F.trim("split")).alias("split"), F.col("participant_source_id").alias("participant"), F.col("modality_coverage").alias("coverage"), (F.col("local_end_sec") - F.col("local_start_sec")).alias("sec")).dropDuplicates(["atom_id"])
    return S.distributions(a, ["split", "participant", "coverage"], {"seconds": F.round(F.sum("sec"), 3)})


@query(
    "quantile_summary",
    f"SELECT count(sec) AS n, min(sec) AS minimum, quantile_cont(sec, 0.5) AS median, quantile_cont(sec, 0.95) AS p95, quantile_cont(sec, 0.99) AS p99, max(sec) AS maximum FROM {_ONE}",
)
def quantile_summary(spark, d):
    """AG9: exact quantiles of window lengths."""
    a = table(spark, d, "source_video_atom").select("atom_id", (F.col("local_end_sec") - F.col("local_start_sec")).alias("sec")).dropDuplicates(["atom_id"])
    return S.quantile_summary(a, "sec")


@query(
    "occupancy_entropy",
    """WITH c AS (SELECT participant_source_id, count(*) AS n FROM (SELECT DISTINCT atom_id, participant_source_id FROM source_video_atom) GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
       SELECT count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_rows, round(max(n) / sum(n), 9) AS largest_share, round(-sum(n / t * ln(n / t)), 9) AS entropy FROM c, t""",
)
def occupancy_entropy(spark, d):
    """AG9: entropy of the windows over participants."""
    a = table(spark, d, "source_video_atom").select("atom_id", "participant_source_id").dropDuplicates(["atom_id"])
    return S.occupancy(a, "participant_source_id").withColumns({c: F.round(c, 9) for c in ("largest_share", "entropy")})


@query(
    "span_measures",
    """WITH s AS (SELECT session_id, min(local_start_sec) AS lo, max(local_end_sec) AS hi, sum(local_end_sec - local_start_sec) AS referenced, count(*) AS n_rows FROM source_video_atom GROUP BY 1),
       u AS (SELECT session_id, sum(sec) AS distinct_sec FROM (SELECT DISTINCT atom_id, session_id, local_end_sec - local_start_sec AS sec FROM source_video_atom) GROUP BY 1)
       SELECT session_id, n_rows, round(referenced, 3) AS referenced, round(distinct_sec, 3) AS distinct_sec, round(hi - lo, 3) AS span FROM s JOIN u USING (session_id)""",
)
def span_measures(spark, d):
    """AG4: length with repetitions, of distinct windows, and from first to last, by session."""
    a = table(spark, d, "source_video_atom").select("atom_id", "session_id", "local_start_sec", "local_end_sec")
    length = F.col("local_end_sec") - F.col("local_start_sec")
    # One shuffle by atom first: repetitions are counted, then both sums come from one row an atom.
    one = a.groupBy("session_id", "atom_id").agg(F.count("*").alias("n"), F.min("local_start_sec").alias("local_start_sec"), F.max("local_end_sec").alias("local_end_sec"))
    return one.groupBy("session_id").agg(
        F.sum("n").alias("n_rows"), F.round(F.sum(length * F.col("n")), 3).alias("referenced"), F.round(F.sum(length), 3).alias("distinct_sec"), F.round(F.max("local_end_sec") - F.min("local_start_sec"), 3).alias("span")
    )


@query("running_extremes", """SELECT event_id, max(value) OVER w AS max_before, last_value(value IGNORE NULLS) OVER w AS last_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_extremes(spark, d):
    """WN3, WN6: the largest and the latest value before each event."""
    order = ["ts", "event_id"]
    rows = ranged(table(spark, d, "events").select("user_id", "event_id", "ts", "value"), "user_id", order)
    rows = running_max(rows, "user_id", order, F.col("value"), "max_before", inclusive=False)
    return first_or_last(rows, "user_id", order, F.col("value"), "last_before", last=True, inclusive=False).select("event_id", "max_before", "last_before")


@query("rule_bank", "SELECT reason, count(DISTINCT cue_id) AS n_cues FROM (SELECT cue_id, unnest(reason_codes) AS reason FROM cue_v2) GROUP BY 1")
def rule_bank(spark, d):
    """DM6: codes of arrays, one row each."""
    return table(spark, d, "cue_v2").select("cue_id", F.explode("reason_codes").alias("reason")).groupBy("reason").agg(F.countDistinct("cue_id").alias("n_cues"))


@query("position_semi_join", "SELECT a.atom_id, c.item_index FROM (SELECT DISTINCT atom_id FROM source_video_atom) a JOIN (SELECT atom_id, min(item_index) AS item_index FROM cue_v2 WHERE disposition = 'accepted_cue' GROUP BY 1) c USING (atom_id)")
def position_semi_join(spark, d):
    """SRC11: source rows of a candidate set, with the candidate's position."""
    c = table(spark, d, "cue_v2").where("disposition = 'accepted_cue'").groupBy("atom_id").agg(F.min("item_index").alias("item_index"))
    return table(spark, d, "source_video_atom").select("atom_id").distinct().join(c, "atom_id")
