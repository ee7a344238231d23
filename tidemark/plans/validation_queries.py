"""Queries that validate whole artifacts: sources, cues, schemas, generated logs, decisions, pairs, stages.

Generated logs are right by construction, so their validators are shown logs that were damaged on
purpose, in places that the seed decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import json_path, whole_word
from tidemark.operators import evidence as E
from tidemark.operators import scenarios as S
from tidemark.operators import validate as V
from tidemark.operators.automaton import REMINDER, run
from tidemark.operators.prefix import ranged, running_max
from tidemark.plans.event_queries import _SEEDS, _seeds
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_ONE_ATOM = """a AS (SELECT DISTINCT atom_id, session_id, source_day, source_group_id, world_event_id, lower(trim(split)) AS split, local_start_sec, local_end_sec, normalized_start_sec, normalized_end_sec,
  video_mapping_status, source_video_path, transcript, dense_caption FROM source_video_atom)"""


@query(
    "source_validation",
    f"""WITH {_ONE_ATOM}, m AS (SELECT session_id, modality, max(end_sec) AS last_sec FROM segments WHERE end_sec IS NOT NULL GROUP BY 1, 2),
        j AS (SELECT a.*, m.last_sec FROM a LEFT JOIN m ON m.session_id = a.session_id AND m.modality = CASE WHEN trim(dense_caption) <> '' THEN 'dense_caption' ELSE 'transcript' END)
        SELECT 'source_time_order' AS issue_type, atom_id AS failure_id FROM j WHERE local_start_sec >= local_end_sec
        UNION ALL SELECT 'source_normalized_time_order', atom_id FROM j WHERE normalized_start_sec >= normalized_end_sec
        UNION ALL SELECT 'subtitle_bounds', atom_id FROM j WHERE local_start_sec < 0 OR local_end_sec > last_sec
        UNION ALL SELECT 'video_path', atom_id FROM j WHERE (video_mapping_status = 'verified') <> (coalesce(source_video_path, '') <> '')
        UNION ALL SELECT 'group_split', source_group_id FROM a WHERE source_group_id IS NOT NULL GROUP BY source_group_id HAVING count(DISTINCT split) > 1
        UNION ALL SELECT 'event_split', world_event_id FROM a WHERE lower(trim(world_event_id)) NOT IN ('', 'none', 'n/a') GROUP BY world_event_id HAVING count(DISTINCT split) > 1""",
)
def source_validation(spark, d):
    """VL3: order of times, subtitle bounds of the primary modality, video paths, one split for a group and an event."""
    a = table(spark, d, "source_video_atom").dropDuplicates(["atom_id"]).withColumn("split", F.lower(F.trim("split")))
    last = table(spark, d, "segments").where("end_sec is not null").groupBy(F.col("session_id").alias("ms"), "modality").agg(F.max("end_sec").alias("last_sec"))
    primary = F.when(F.trim("dense_caption") != "", "dense_caption").otherwise("transcript")
    j = a.join(last, (F.col("session_id") == F.col("ms")) & (primary == F.col("modality")), "left")
    fails = {
        "source_time_order": F.col("local_start_sec") >= F.col("local_end_sec"),
        "source_normalized_time_order": F.col("normalized_start_sec") >= F.col("normalized_end_sec"),
        "subtitle_bounds": (F.col("local_start_sec") < 0) | (F.col("local_end_sec") > F.col("last_sec")),
        "video_path": (F.col("video_mapping_status") == "verified") != (F.coalesce("source_video_path", F.lit("")) != ""),
    }
    rows = V.checks(j, "atom_id", {k: ~F.coalesce(c, F.lit(False)) for k, c in fails.items()})
    groups = V.functional(a.where("source_group_id is not null"), "source_group_id", "split").withColumn("issue_type", F.lit("group_split"))
    real = a.where(~F.lower(F.trim("world_event_id")).isin("", "none", "n/a"))
    events = V.functional(real, "world_event_id", "split").withColumn("issue_type", F.lit("event_split"))
    return V.every(rows, groups, events).select("issue_type", "failure_id")


# FIXED VALUES: the operators of each dimension, those that deny, words that refer to something that is
# not named, words of negation and of scope, words that go with speaking and with the operators of places.
MATRIX = {
    "person": ("present", "absent", "speaking", "mentioned"),
    "location": ("at", "not_at", "entering", "leaving"),
    "object": ("present", "absent", "held", "placed"),
    "activity": ("starts", "ongoing", "ends", "not_occurring"),
    "state": ("is", "is_not", "changes_to"),
    "explicit_time": ("stated", "planned", "hypothetical"),
}
DENYING = ("absent", "not_at", "not_occurring", "is_not")
REFERENTS = ("我", "他", "她", "它", "这里", "那里", "这个", "那个", "东西", "正在做", "发生变化")
NEGATION = ("没有", "不是", "不在", "没", "不", "未", "no", "not", "never", "without")
SCOPE = ("所有", "全部", "每个", "一个", "两个", "only", "all", "every", "one", "two")
SPEAKING = ("说", "讲话", "says", "speaking")
PLACES = {"at": ("在", "位于", " at ", " in "), "not_at": ("不在", "not at"), "entering": ("进入", "进", "enter"), "leaving": ("离开", "出", "leave")}

_FLAT = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def _word_sql(text: str, word: str) -> str:
    return f"regexp_matches({text}, '(?i)(^|[^A-Za-z]){word}([^A-Za-z]|$)')" if word.isascii() else f"contains({text}, '{word}')"


_NEG_SQL = "(" + " OR ".join(_word_sql("span", w) for w in NEGATION) + ")"
_SCOPE_SQL = "(" + " OR ".join(f"({_word_sql('span', w)} AND NOT {_word_sql('flat', w)})" for w in SCOPE) + ")"
_MATRIX_SQL = "CASE dimension " + " ".join(f"WHEN '{k}' THEN operator IN {v!r}" for k, v in MATRIX.items()) + " ELSE false END"
_SPEAK_SQL = "(contains(span, ':') OR " + " OR ".join(f"contains(lower(span), '{w}')" for w in SPEAKING) + ")"
_PLACE_SQL = "CASE operator " + " ".join(f"WHEN '{k}' THEN " + " OR ".join(f"contains(lower(span), '{w}')" for w in v) for k, v in PLACES.items()) + " ELSE false END"
_RULES_SQL = f"""k AS (SELECT cue_id, atom_id, unnest(range(len(predicate.all_of)))::INTEGER AS clause_index, unnest(predicate.all_of) AS c FROM (SELECT DISTINCT cue_id, atom_id, predicate FROM cue_v2 WHERE predicate IS NOT NULL)),
cl AS (SELECT DISTINCT cue_id, atom_id, clause_index, c.dimension AS dimension, c.operator AS operator, c.value AS value, c.evidence.field AS field, c.evidence.span AS span FROM k),
a AS (SELECT DISTINCT atom_id, transcript, dense_caption FROM source_video_atom),
j AS (SELECT cl.*, {_FLAT.format("value")} AS flat, a.atom_id IS NULL AS orphan, coalesce(span <> '' AND contains(CASE field WHEN 'transcript' THEN transcript WHEN 'dense_caption' THEN dense_caption END, span), false) AS own,
  coalesce(span <> '' AND contains(CASE field WHEN 'transcript' THEN dense_caption WHEN 'dense_caption' THEN transcript END, span), false) AS other FROM cl LEFT JOIN a USING (atom_id)),
v AS (SELECT cue_id, clause_index, CASE WHEN orphan THEN 'MISSING_ATOM' WHEN coalesce(field NOT IN ('transcript', 'dense_caption'), true) OR (NOT own AND other) THEN 'CROSS_FIELD_EVIDENCE' WHEN NOT own THEN 'SPAN_NOT_CONTIGUOUS'
  WHEN coalesce(flat, '') = '' OR NOT contains({_FLAT.format("span")}, flat) OR lower(flat) IN ('null', 'none', 'unknown', 'n/a', 'na', 'nil', '无', '未知') THEN 'VALUE_NOT_SUPPORTED'
  WHEN flat IN {REFERENTS!r} THEN 'UNRESOLVED_REFERENT' WHEN NOT coalesce({_MATRIX_SQL}, false) THEN 'SEMANTIC_DIMENSION_MISMATCH'
  WHEN operator NOT IN {DENYING!r} AND {_NEG_SQL} THEN 'OPERATOR_POLARITY_MISMATCH'
  WHEN {_SCOPE_SQL} OR (regexp_matches(span, '[0-9]') AND NOT regexp_matches(flat, '[0-9]')) THEN 'SCOPE_MISMATCH'
  WHEN dimension = 'person' AND operator = 'speaking' AND NOT {_SPEAK_SQL} THEN 'PERSON_ROLE_MISMATCH' END AS code,
  coalesce((operator IN {DENYING!r} AND NOT {_NEG_SQL}) OR (dimension = 'person' AND operator = 'present') OR dimension = 'activity' OR (dimension = 'location' AND NOT ({_PLACE_SQL})), false) AS audit FROM j)"""


def clause_codes(spark, d):
    """cue_id, clause_index, code, audit: the first rule that each clause breaks (null for none), and whether a person must look.

    White space is collapsed before a value is looked for in its span.
    """
    texts = table(spark, d, "source_video_atom").select("atom_id", "transcript", "dense_caption").dropDuplicates(["atom_id"]).withColumn("known", F.lit(True))
    j = E.exploded(table(spark, d, "cue_v2")).join(texts, "atom_id", "left")
    span, operator, dimension = F.col("span"), F.col("operator"), F.col("dimension")
    flat = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))
    value = flat(F.col("value"))
    either = lambda conditions: reduce(lambda x, y: x | y, conditions)
    holds = lambda c: F.coalesce(c, F.lit(False))
    negated = either(whole_word(span, w) for w in NEGATION)
    widened = either(whole_word(span, w) & ~whole_word(value, w) for w in SCOPE)
    low = F.lower(span)
    place = F.lit(False)
    for name, words in PLACES.items():
        place = F.when(operator == name, either(F.contains(low, F.lit(w)) for w in words)).otherwise(place)
    ground = E.grounding_code(F.col("field"), span, span, F.col("transcript"), F.col("dense_caption"))
    code = (
        F.when(F.col("known").isNull(), "MISSING_ATOM")
        .when(ground.isin("CROSS_FIELD_EVIDENCE", "SPAN_NOT_CONTIGUOUS"), ground)
        .when((F.coalesce(value, F.lit("")) == "") | ~F.contains(flat(span), value) | F.lower(value).isin(*E.SENTINELS), "VALUE_NOT_SUPPORTED")
        .when(value.isin(*REFERENTS), "UNRESOLVED_REFERENT")
        .when(~holds(either((dimension == k) & operator.isin(*v) for k, v in MATRIX.items())), "SEMANTIC_DIMENSION_MISMATCH")
        .when(~operator.isin(*DENYING) & negated, "OPERATOR_POLARITY_MISMATCH")
        .when(widened | (span.rlike("[0-9]") & ~value.rlike("[0-9]")), "SCOPE_MISMATCH")
        .when((dimension == "person") & (operator == "speaking") & ~(F.contains(span, F.lit(":")) | either(F.contains(low, F.lit(w)) for w in SPEAKING)), "PERSON_ROLE_MISMATCH")
    )
    audit = (operator.isin(*DENYING) & ~negated) | ((dimension == "person") & (operator == "present")) | (dimension == "activity") | ((dimension == "location") & ~place)
    return j.select("cue_id", "clause_index", code.alias("code"), holds(audit).alias("audit"))


@query("cue_validation", f"WITH {_RULES_SQL} SELECT cue_id, clause_index, coalesce(code, 'ok') AS code, CASE WHEN code IS NOT NULL THEN '$.predicate.all_of[' || clause_index || ']' END AS path FROM v")
def cue_validation(spark, d):
    """DM1, VL4, PRJ26: the first broken rule of each clause, and the path to the clause."""
    v = clause_codes(spark, d)
    path = F.when(F.col("code").isNotNull(), json_path("predicate", "all_of", F.col("clause_index")))
    return v.select("cue_id", "clause_index", F.coalesce("code", F.lit("ok")).alias("code"), path.alias("path"))


@query(
    "cue_verdicts",
    f"""WITH {_RULES_SQL} SELECT cue_id, CASE WHEN count(code) > 0 THEN 'rejected' WHEN bool_or(audit) OR count(*) > 1 THEN 'needs_semantic_audit' ELSE 'accepted_machine' END AS status, count(*) AS n_clauses, count(code) AS n_broken FROM v GROUP BY 1""",
)
def cue_verdicts(spark, d):
    """DM1: accepted, to be audited, or rejected, from all clauses of a cue."""
    per = clause_codes(spark, d).groupBy("cue_id").agg(F.bool_or("audit").alias("audit"), F.count("*").alias("n_clauses"), F.count("code").alias("n_broken"))
    status = F.when(F.col("n_broken") > 0, "rejected").when(F.col("audit") | (F.col("n_clauses") > 1), "needs_semantic_audit").otherwise("accepted_machine")
    return per.select("cue_id", status.alias("status"), "n_clauses", "n_broken")


_BOTH = "concat_ws(chr(10), transcript, dense_caption)"


@query(
    "lexicon_marks",
    f"""SELECT DISTINCT atom_id, {" OR ".join(_word_sql(_BOTH, w) for w in NEGATION)} AS negated, {" OR ".join(_word_sql(_BOTH, w) for w in SCOPE)} AS scoped FROM source_video_atom""",
)
def lexicon_marks(spark, d):
    """PRJ23: negation and scope, by whole English words and by CJK marks, in both texts of every window."""
    text = F.concat_ws("\n", "transcript", "dense_caption")
    either = lambda words: reduce(lambda x, y: x | y, [whole_word(text, w) for w in words])
    return table(spark, d, "source_video_atom").select("atom_id", either(NEGATION).alias("negated"), either(SCOPE).alias("scoped")).distinct()


#: Fields that each table must have, with their types, and fields that it must not have.
CONTRACTS = {
    "source_video_atom": ({"atom_id": "string", "session_id": "string", "local_start_sec": "double", "local_end_sec": "double", "transcript_segment_ids": "array<string>", "clip_uri": "string"}, ("received_at", "gold_action")),
    "segments": ({"segment_id": "string", "start_sec": "double", "end_sec": "double", "srt_block_index": "bigint"}, ("gold_action",)),
    "cue_v2": ({"cue_id": "string", "atom_id": "string", "reason_codes": "array<string>"}, ()),
}


@query(
    "schema_conformance",
    """SELECT * FROM (VALUES ('source_video_atom', 'missing_column', 'clip_uri', 'string', 'absent'), ('source_video_atom', 'forbidden_column', 'received_at', 'absent', 'timestamp'),
       ('segments', 'column_type', 'srt_block_index', 'bigint', 'int')) t(table_name, issue_type, failure_id, expected, actual)""",
)
def schema_conformance(spark, d):
    """VL1, VL11: required, typed and forbidden fields of each table, from metadata alone."""
    found = None
    for name, (required, forbidden) in CONTRACTS.items():
        part = V.schema_issues(table(spark, d, name), required, forbidden).select(F.lit(name).alias("table_name"), "issue_type", "failure_id", "expected", F.regexp_replace("actual", "_ntz$", "").alias("actual"))
        found = part if found is None else found.unionByName(part)
    return found


@query(
    "first_errors",
    """WITH s AS (SELECT DISTINCT segment_id, modality, source_day, srt_block_index, parse_status, start_sec, end_sec, text FROM segments),
       e AS (SELECT segment_id, list_sort(list_filter([CASE WHEN NOT coalesce(end_sec > start_sec, parse_status <> 'ok') THEN '$.end_sec' END, CASE WHEN NOT regexp_full_match(segment_id, '(tr2|dc2)_P[0-9]+_DAY[1-7]_S[0-9]+_[0-9]{6}') THEN '$.segment_id' END,
         CASE WHEN modality NOT IN ('transcript', 'dense_caption') THEN '$.modality' END, CASE WHEN NOT coalesce(srt_block_index >= 1, false) THEN '$.srt_block_index' END, CASE WHEN parse_status <> 'ok' THEN '$.parse_status' END,
         CASE WHEN NOT coalesce(trim(text) <> '', false) THEN '$.text' END], lambda x: x IS NOT NULL)) AS paths FROM s)
       SELECT segment_id, paths[1] AS first_path, len(paths) AS n_errors FROM e WHERE len(paths) > 0""",
)
def first_errors(spark, d):
    """VL1: all errors of a record in the order of their paths, and the first of them."""
    s = table(spark, d, "segments").select("segment_id", "modality", "source_day", "srt_block_index", "parse_status", "start_sec", "end_sec", "text").dropDuplicates(["segment_id"])
    rules = {
        "end_sec": F.coalesce(F.col("end_sec") > F.col("start_sec"), F.col("parse_status") != "ok"),
        "segment_id": F.col("segment_id").rlike("^(tr2|dc2)_P[0-9]+_DAY[1-7]_S[0-9]+_[0-9]{6}$"),
        "modality": F.col("modality").isin("transcript", "dense_caption"),
        "srt_block_index": F.col("srt_block_index") >= 1,
        "parse_status": F.col("parse_status") == "ok",
        "text": F.trim("text") != "",
    }
    errors = F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), json_path(name)) for name, c in rules.items()])))
    return s.withColumn("paths", errors).where(F.size("paths") > 0).select("segment_id", F.element_at("paths", 1).alias("first_path"), F.size("paths").alias("n_errors"))


_DAMAGED = f"""{_SEEDS}, q AS (SELECT seed_id, branch, difficulty, position, role, seed_id || '/' || branch || '/' || difficulty AS log,
  CASE WHEN position = n - 1 THEN trigger_atom_id WHEN position = 1 THEN lure_1 WHEN position = middle THEN lure_2 END AS atom_id, CASE WHEN seed_id = 'n7' AND position = 5 THEN sec - 7200 ELSE sec END AS sec FROM z
  WHERE NOT (seed_id = 'n3' AND position = 4) AND NOT (seed_id = 'n11' AND difficulty = 'medium' AND branch = 'negative')),
l AS (SELECT seed_id, branch, difficulty, position, CASE WHEN seed_id = 'n5' AND role = 'creation' THEN 'background' ELSE role END AS role, log, CASE WHEN seed_id = 'n9' AND branch = 'negative' AND role = 'trigger' THEN 'src_other' ELSE atom_id END AS atom_id, sec FROM q)"""


def _damaged(spark, d):
    """Generated logs with places taken out, a time set back, a creation lost, a trigger exchanged, a log missing."""
    x = S.expand(_seeds(spark, d))
    seed, place = F.col("seed_id"), F.col("position")
    kept = x.where(~((seed == "n3") & (place == 4)) & ~((seed == "n11") & (F.col("difficulty") == "medium") & (F.col("branch") == "negative")))
    role = F.when((seed == "n5") & (F.col("role") == "creation"), "background").otherwise(F.col("role"))
    atom = F.when((seed == "n9") & (F.col("branch") == "negative") & (F.col("role") == "trigger"), "src_other").otherwise(F.col("atom_id"))
    back = F.when((seed == "n7") & (place == 5), 7200).otherwise(0)
    from tidemark.functions.times import virtual_seconds

    return kept.select(
        "seed_id", "branch", "difficulty", "position", role.alias("role"), F.concat_ws("/", "seed_id", "branch", "difficulty").alias("log"), atom.alias("atom_id"), (virtual_seconds(F.col("virtual_time")) - back).alias("sec")
    )


@query(
    "log_validation",
    f"""WITH {_DAMAGED}, w AS (SELECT *, sec < lag(sec) OVER (PARTITION BY log ORDER BY position) AS back FROM l),
        p AS (SELECT log, difficulty, count(*) AS n, max(position) AS hi, bool_or(back) AS back, count(*) FILTER (role = 'trigger') AS triggers, count(*) FILTER (role = 'creation') AS creations, bool_or(branch = 'positive') AS positive FROM w GROUP BY 1, 2),
        v AS (SELECT log AS failure_id, unnest(['event_count', 'positions', 'time_order', 'one_trigger', 'creation']) AS issue_type,
          unnest([n <> CASE difficulty WHEN 'short' THEN 12 WHEN 'medium' THEN 35 ELSE 90 END, hi <> n - 1, coalesce(back, false), triggers <> 1, positive AND creations <> 1]) AS bad FROM p) SELECT issue_type, failure_id FROM v WHERE bad""",
)
def log_validation(spark, d):
    """VL6: counts, positions, order of times, one trigger and the creation of each log."""
    w = _damaged(spark, d).withColumn("back", F.col("sec") < F.lag("sec").over(Window.partitionBy("log").orderBy("position")))
    per = w.groupBy("log", "difficulty").agg(
        F.count("*").alias("n"), F.max("position").alias("hi"), F.bool_or("back").alias("back"), F.count_if(F.col("role") == "trigger").alias("triggers"), F.count_if(F.col("role") == "creation").alias("creations"), F.bool_or(F.col("branch") == "positive").alias("positive")
    )
    wanted = F.when(F.col("difficulty") == "short", 12).when(F.col("difficulty") == "medium", 35).otherwise(90)
    rules = {
        "event_count": F.col("n") == wanted,
        "positions": F.col("hi") == F.col("n") - 1,
        "time_order": ~F.coalesce("back", F.lit(False)),
        "one_trigger": F.col("triggers") == 1,
        "creation": ~F.col("positive") | (F.col("creations") == 1),
    }
    return V.checks(per, "log", rules).select("issue_type", "failure_id")


@query(
    "chain_validation",
    f"""WITH RECURSIVE {_DAMAGED}, o AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY position) AS k FROM l),
        f AS (SELECT log, k, role, 'never_created' AS before, CASE role WHEN 'creation' THEN 'active_unreminded' WHEN 'completed' THEN 'illegal' WHEN 'cancelled' THEN 'illegal' WHEN 'expired' THEN 'illegal' ELSE 'never_created' END AS after FROM o WHERE k = 1
          UNION ALL SELECT o.log, o.k, o.role, f.after, CASE WHEN f.after = 'illegal' THEN 'illegal' WHEN o.role = 'creation' THEN CASE WHEN f.after = 'never_created' THEN 'active_unreminded' ELSE 'illegal' END
            WHEN o.role IN ('completed', 'cancelled', 'expired') THEN CASE WHEN f.after = 'active_unreminded' THEN o.role ELSE 'illegal' END WHEN o.role = 'trigger' AND f.after = 'active_unreminded' THEN 'active_reminded' ELSE f.after END
          FROM f JOIN o ON o.log = f.log AND o.k = f.k + 1)
        SELECT log AS failure_id, before AS state_at_trigger, after AS state_after FROM f WHERE role = 'trigger' AND (after = 'illegal' OR (after = 'active_reminded') <> (log LIKE '%/positive/%'))""",
)
def chain_validation(spark, d):
    """VL6, VL8, DM13: logs whose states at the trigger are not what their branch, looked at without the machine, asks for."""
    r = run(_damaged(spark, d), REMINDER, "log", ["position"], "role", F.floor(F.col("position") / 50)).where("role = 'trigger'")
    expected = F.col("branch") == "positive"
    bad = r.where((F.col("state_after") == "illegal") | ((F.col("state_after") == "active_reminded") != expected))
    return bad.select(F.col("log").alias("failure_id"), F.col("state_before").alias("state_at_trigger"), "state_after")


@query(
    "family_validation",
    f"""WITH {_DAMAGED}, p AS (SELECT seed_id, difficulty, branch, count(*) AS n, max(sec) - min(sec) AS span, max(atom_id) FILTER (role = 'trigger') AS trig FROM l GROUP BY 1, 2, 3),
        s AS (SELECT seed_id, count(*) AS variants, count(DISTINCT trig) AS triggers, max(n) FILTER (difficulty = 'short') AS ns, min(n) FILTER (difficulty = 'medium') AS nm, max(n) FILTER (difficulty = 'medium') AS nm2, min(n) FILTER (difficulty = 'long') AS nl,
          max(span) FILTER (difficulty = 'short') AS ss, min(span) FILTER (difficulty = 'medium') AS sm, max(span) FILTER (difficulty = 'medium') AS sm2, min(span) FILTER (difficulty = 'long') AS sl FROM p GROUP BY 1)
        SELECT seed_id, variants, triggers, ns < nm AND nm2 < nl AS counts_grow, ss < sm AND sm2 < sl AS spans_grow, variants = 6 AND triggers = 1 AND ns < nm AND nm2 < nl AND ss < sm AND sm2 < sl AS valid FROM s""",
)
def family_validation(spark, d):
    """VL7: six variants of one trigger for each seed, growing from short to long."""
    p = _damaged(spark, d).groupBy("seed_id", "difficulty", "branch").agg(F.count("*").alias("n"), (F.max("sec") - F.min("sec")).alias("span"), F.max(F.when(F.col("role") == "trigger", F.col("atom_id"))).alias("trig"))
    of = lambda f, c, x: f(F.when(F.col("difficulty") == x, F.col(c)))
    grows = lambda c: (of(F.max, c, "short") < of(F.min, c, "medium")) & (of(F.max, c, "medium") < of(F.min, c, "long"))
    s = p.groupBy("seed_id").agg(F.count("*").alias("variants"), F.countDistinct("trig").alias("triggers"), grows("n").alias("counts_grow"), grows("span").alias("spans_grow"))
    return s.withColumn("valid", (F.col("variants") == 6) & (F.col("triggers") == 1) & F.col("counts_grow") & F.col("spans_grow"))


@query(
    "pair_validation",
    f"""WITH {_DAMAGED}, t AS (SELECT seed_id, difficulty, branch, max(atom_id) FILTER (role = 'trigger') AS trig, bool_or(role = 'creation') AND NOT bool_or(role IN ('completed', 'cancelled', 'expired')) AS acts FROM l GROUP BY 1, 2, 3),
        p AS (SELECT seed_id, difficulty, count(*) AS n, count(DISTINCT branch) AS branches, count(DISTINCT trig) AS triggers, bool_or(acts) FILTER (branch = 'positive') AS a, bool_or(acts) FILTER (branch = 'negative') AS b FROM t GROUP BY 1, 2)
        SELECT seed_id, difficulty, CASE WHEN n <> 2 THEN 'cardinality' WHEN branches <> 2 THEN 'branches' WHEN triggers <> 1 THEN 'trigger' WHEN NOT (a AND NOT b) THEN 'no_flip' ELSE 'ok' END AS code FROM p""",
)
def pair_validation(spark, d):
    """VL9: the first rule that each counterfactual pair breaks: two logs, two branches, one trigger, an outcome that flips."""
    role = F.col("role")
    acts = F.bool_or(role == "creation") & ~F.bool_or(role.isin("completed", "cancelled", "expired"))
    t = _damaged(spark, d).groupBy("seed_id", "difficulty", "branch").agg(F.max(F.when(role == "trigger", F.col("atom_id"))).alias("trig"), acts.alias("acts"))
    p = t.groupBy("seed_id", "difficulty").agg(
        F.count("*").alias("n"), F.countDistinct("branch").alias("branches"), F.countDistinct("trig").alias("triggers"), F.bool_or(F.when(F.col("branch") == "positive", F.col("acts"))).alias("a"), F.bool_or(F.when(F.col("branch") == "negative", F.col("acts"))).alias("b")
    )
    code = F.when(F.col("n") != 2, "cardinality").when(F.col("branches") != 2, "branches").when(F.col("triggers") != 1, "trigger").when(~(F.col("a") & ~F.col("b")), "no_flip").otherwise("ok")
    return p.select("seed_id", "difficulty", code.alias("code"))


@query(
    "seed_validation",
    """WITH s AS (SELECT 'p' || p_partkey AS seed_id, 's' || (p_partkey % 97) AS trigger_id, ['s' || (p_partkey % 89), 's' || (p_partkey % 83), 's' || (p_partkey % 13)] AS lures,
         CASE p_partkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'expired' WHEN 3 THEN 'never_created' ELSE 'postponed' END AS kind, p_size AS opens, p_size % 7 * 9 AS closes FROM part),
       v AS (SELECT seed_id, unnest(['trigger_in_lures', 'lures_repeat', 'terminal_kind', 'window_order', 'lure_unknown']) AS code,
         unnest([list_contains(lures, trigger_id), len(list_distinct(lures)) < 3, kind NOT IN ('completed', 'cancelled', 'expired', 'never_created'), opens > closes, NOT list_has_all((SELECT list('s' || s_suppkey) FROM supplier), lures)]) AS bad FROM s)
       SELECT seed_id, code FROM v WHERE bad""",
)
def seed_validation(spark, d):
    """DM4, VL5, JN11: rules of each seed: trigger outside its lures, different and known lures, kind, order of the window."""
    k = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("s"), (k % n).cast("string"))
    kind = F.when(k % 5 == 0, "completed").when(k % 5 == 1, "cancelled").when(k % 5 == 2, "expired").when(k % 5 == 3, "never_created").otherwise("postponed")
    s = table(spark, d, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("seed_id"), name(97).alias("trigger_id"), F.array(name(89), name(83), name(13)).alias("lures"), kind.alias("kind"), F.col("p_size").alias("opens"), (F.col("p_size") % 7 * 9).alias("closes"))
    known = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("lure"))
    strangers = s.select("seed_id", F.explode("lures").alias("lure")).join(known, "lure", "left_anti").select("seed_id").distinct().withColumn("strange", F.lit(True))
    rules = {
        "trigger_in_lures": ~F.array_contains("lures", F.col("trigger_id")),
        "lures_repeat": F.size(F.array_distinct("lures")) == 3,
        "terminal_kind": F.col("kind").isin("completed", "cancelled", "expired", "never_created"),
        "window_order": F.col("opens") <= F.col("closes"),
        "lure_unknown": F.col("strange").isNull(),
    }
    return V.checks(s.join(strangers, "seed_id", "left"), "seed_id", rules).select(F.col("failure_id").alias("seed_id"), F.col("issue_type").alias("code"))


@query(
    "adjacent_sessions",
    """WITH s AS (SELECT DISTINCT participant_source_id AS p, source_day AS day, session_id, CAST(regexp_extract(session_id, '([0-9]+)$', 1) AS BIGINT) AS tail FROM source_video_atom WHERE session_id IS NOT NULL)
       SELECT a.session_id AS session_1, b.session_id AS session_2 FROM s a JOIN s b ON a.p = b.p AND a.day = b.day AND b.tail = a.tail + 1""",
)
def adjacent_sessions(spark, d):
    """VL12: sessions of a participant and day whose numbers follow each other; an equi-join on the next number."""
    s = table(spark, d, "source_video_atom").where("session_id is not null").select("participant_source_id", "source_day", "session_id").distinct()
    s = s.withColumn("tail", F.regexp_extract("session_id", "([0-9]+)$", 1).cast("bigint"))
    after = s.select("participant_source_id", "source_day", F.col("session_id").alias("session_2"), (F.col("tail") - 1).alias("tail"))
    return s.withColumnRenamed("session_id", "session_1").join(after, ["participant_source_id", "source_day", "tail"]).select("session_1", "session_2")


#: Stages and what each reads.
STAGES = (("source", ()), ("segments", ()), ("cues", ("source",)), ("seeds", ("cues",)), ("logs", ("seeds",)), ("statistics", ("source", "segments", "logs")))


@query(
    "stage_gate",
    """WITH RECURSIVE b AS (SELECT 'source' AS stage, count(*) AS n FROM (SELECT 1 FROM source_video_atom GROUP BY atom_id HAVING count(DISTINCT session_id) > 1) UNION ALL
         SELECT 'segments', count(DISTINCT segment_id) FROM segments WHERE parse_status = 'error' UNION ALL SELECT 'cues', count(*) FROM (SELECT DISTINCT atom_id FROM cue_v2) WHERE atom_id NOT IN (SELECT atom_id FROM source_video_atom)
         UNION ALL SELECT 'seeds', 0 UNION ALL SELECT 'logs', 0 UNION ALL SELECT 'statistics', 0),
       e AS (SELECT * FROM (VALUES ('cues', 'source'), ('seeds', 'cues'), ('logs', 'seeds'), ('statistics', 'source'), ('statistics', 'segments'), ('statistics', 'logs')) t(stage, needs)),
       r AS (SELECT stage, stage AS above FROM b UNION SELECT r.stage, e.needs FROM r JOIN e ON e.stage = r.above)
       SELECT r.stage, max(b.n) FILTER (r.above = r.stage) AS n_blockers, sum(b.n) = 0 AS ready FROM r JOIN b ON b.stage = r.above GROUP BY 1""",
)
def stage_gate(spark, d):
    """VL10, VL13: a stage is ready if neither it nor any stage above it has blockers."""
    atoms, cues = table(spark, d, "source_video_atom"), table(spark, d, "cue_v2")
    counted = {
        "source": atoms.groupBy("atom_id").agg(F.countDistinct("session_id").alias("n")).where("n > 1").select(F.lit("source").alias("stage")),
        "segments": table(spark, d, "segments").where("parse_status = 'error'").select("segment_id").distinct().select(F.lit("segments").alias("stage")),
        "cues": cues.select("atom_id").distinct().join(atoms, "atom_id", "left_anti").select(F.lit("cues").alias("stage")),
    }
    found = counted["source"].union(counted["segments"]).union(counted["cues"]).groupBy("stage").agg(F.count("*").alias("n"))
    above: dict[str, set[str]] = {}
    for name, needs in STAGES:
        above[name] = {name}.union(*(above[x] for x in needs))
    pairs = spark.createDataFrame([(s, a) for s, all_ in above.items() for a in sorted(all_)], "name string, stage string")
    joined = pairs.join(found, "stage", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.groupBy(F.col("name").alias("stage")).agg(F.max(F.when(F.col("stage") == F.col("name"), F.col("n"))).alias("n_blockers"), (F.sum("n") == 0).alias("ready"))


@query(
    "length_checks",
    "SELECT doc_id, n_chars, length(text) AS counted, CASE WHEN n_chars IS NULL AND text IS NULL THEN 'ok' WHEN n_chars IS NULL OR text IS NULL THEN 'one_side_null' WHEN n_chars < 0 THEN 'negative' WHEN n_chars <> length(text) THEN 'differs' ELSE 'ok' END AS code FROM documents",
)
def length_checks(spark, d):
    """VL16, VL21: a stated amount is there with its text, is not negative and equals what the text gives."""
    n, text = F.col("n_chars"), F.col("text")
    code = F.when(n.isNull() & text.isNull(), "ok").when(n.isNull() | text.isNull(), "one_side_null").when(n < 0, "negative").when(n != F.length(text), "differs").otherwise("ok")
    return table(spark, d, "documents").select("doc_id", "n_chars", F.length("text").alias("counted"), code.alias("code"))


@query(
    "audited_labels",
    """WITH l AS (SELECT DISTINCT doc_id, lower(trim(subject)) AS label, annotator FROM subject_label), r AS (SELECT lower(trim(subject)) AS label, subject_id FROM subject_ref),
       j AS (SELECT doc_id, label, annotator, subject_id, CASE WHEN coalesce(label, '') = '' OR coalesce(trim(annotator), '') = '' THEN 'incomplete' WHEN label = 'none' OR subject_id IS NOT NULL THEN 'accepted' ELSE 'unknown' END AS status FROM l LEFT JOIN r USING (label))
       SELECT doc_id, count(DISTINCT label) FILTER (status = 'accepted') AS n_accepted, count(*) FILTER (status = 'unknown') AS n_unknown, count(*) FILTER (status = 'incomplete') AS n_incomplete,
         coalesce(bool_or(label = 'none') FILTER (status = 'accepted'), false) AND count(DISTINCT label) FILTER (status = 'accepted') > 1 AS contradiction FROM j GROUP BY 1""",
)
def audited_labels(spark, d):
    """DM5: annotations in whatever spelling: accepted, unknown and incomplete ones, and documents where they contradict each other."""
    labels = table(spark, d, "subject_label").select("doc_id", F.lower(F.trim("subject")).alias("label"), "annotator").distinct()
    ref = table(spark, d, "subject_ref").select(F.lower(F.trim("subject")).alias("label"), "subject_id")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    status = F.when(empty("label") | empty("annotator"), "incomplete").when((F.col("label") == "none") | F.col("subject_id").isNotNull(), "accepted").otherwise("unknown")
    j = labels.join(ref, "label", "left").withColumn("status", status)
    good = F.col("status") == "accepted"
    per = j.groupBy("doc_id").agg(
        F.countDistinct(F.when(good, F.col("label"))).alias("n_accepted"), F.count_if(F.col("status") == "unknown").alias("n_unknown"), F.count_if(F.col("status") == "incomplete").alias("n_incomplete"), F.coalesce(F.bool_or(F.when(good, F.col("label") == "none")), F.lit(False)).alias("none")
    )
    return per.withColumn("contradiction", F.col("none") & (F.col("n_accepted") > 1)).drop("none")


@query(
    "order_rejects",
    """SELECT event_id, user_id, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS rejected FROM events""",
)
def order_rejects(spark, d):
    """SS2: in the order of arrival, events older than one of their key that came before are rejected, without tolerance."""
    rows = ranged(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["event_id"])
    seen = running_max(rows, "user_id", ["event_id"], F.col("ts"), "latest", inclusive=False)
    return seen.select("event_id", "user_id", F.coalesce(F.col("ts") < F.col("latest"), F.lit(False)).alias("rejected"))
