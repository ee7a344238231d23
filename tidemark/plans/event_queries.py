"""Queries of keyed events: the state machine in batch and stream, evidence, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.times import virtual_seconds, virtual_text
from tidemark.operators import scenarios as S
from tidemark.operators.automaton import REMINDER, run
from tidemark.operators.prefix import ranged, running_sum
from tidemark.plans.registry import query
from tidemark.sources.tables import stream_table, table
from tidemark.streaming.keyed import anchored_hits, machine_stream, run_to_end, windowed_counts

_SYMBOL = "CASE event_type WHEN 'signup' THEN 'creation' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled' WHEN 'click' THEN 'trigger' ELSE 'lure' END"
_MOVE = """CASE WHEN s = 'illegal' THEN s WHEN sym = 'creation' THEN CASE WHEN s = 'never_created' THEN 'active_unreminded' ELSE 'illegal' END
  WHEN sym IN ('completed', 'cancelled') THEN CASE WHEN s = 'active_unreminded' THEN sym ELSE 'illegal' END
  WHEN sym = 'trigger' AND s = 'active_unreminded' THEN 'active_reminded' ELSE s END"""
_FOLD = f"""e AS (SELECT user_id, event_id, ts, {_SYMBOL} AS sym, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, s AS state_before, {_MOVE} AS state_after FROM (SELECT *, 'never_created' AS s FROM e WHERE n = 1)
  UNION ALL SELECT user_id, n, event_id, s, {_MOVE} FROM (SELECT e.*, f.state_after AS s FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))"""
_MACHINE = f"WITH RECURSIVE {_FOLD} SELECT user_id, event_id, state_before, state_after FROM f"


def _symbol():
    t = F.col("event_type")
    return F.when(t == "signup", "creation").when(t == "purchase", "completed").when(t == "error", "cancelled").when(t == "click", "trigger").otherwise("lure")


def _run(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", _symbol().alias("role"))
    return run(e, REMINDER, "user_id", ["ts", "event_id"], "role", F.unix_date(F.col("ts").cast("date")))


@query("state_machine", _MACHINE)
def state_machine(spark, d):
    """DM9, FLT3: every user's machine, states before and after each event, by parallel prefix."""
    return _run(spark, d).select("user_id", "event_id", "state_before", "state_after")


@query("stream_state_machine", _MACHINE)
def stream_state_machine(spark, d):
    """SS1: the same machine over a stream, one state value a user."""
    return run_to_end(lambda: machine_stream(stream_table(spark, d, "events").select("user_id", "event_id", "ts", _symbol().alias("role")), REMINDER, "user_id", "event_id", "ts", "role"), spark)


@query("stream_event_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark, d):
    """SS4: daily counts by type over a stream with a watermark."""
    return run_to_end(lambda: windowed_counts(stream_table(spark, d, "events").select("ts", "event_type"), "ts", "event_type", "1 day", "2 days"), spark, "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "decisions",
    f"""WITH RECURSIVE {_FOLD} SELECT f.event_id, e.sym AS role, CASE WHEN sym = 'trigger' THEN 'trigger' WHEN sym = 'lure' THEN CASE state_before WHEN 'completed' THEN 'post_completion_lure'
          WHEN 'cancelled' THEN 'post_cancellation_lure' WHEN 'expired' THEN 'post_expiry_lure' WHEN 'active_reminded' THEN 'already_reminded_lure' ELSE 'non_trigger_lure' END ELSE 'ordinary_silence' END AS decision_type,
        CASE WHEN sym = 'trigger' AND state_before = 'active_unreminded' THEN 'remind' ELSE 'silent' END AS action FROM f JOIN e USING (user_id, n)""",
)
def decisions(spark, d):
    """DM10: what each event decides; chain_validation recomputes it from the annotation."""
    r = _run(spark, d)
    acts = (F.col("role") == "trigger") & (F.col("state_before") == "active_unreminded")
    return r.select("event_id", "role", S.decision_type(F.col("role"), F.col("state_before")).alias("decision_type"), F.when(acts, "remind").otherwise("silent").alias("action"))


@query(
    "prefix_evidence",
    f"""WITH e AS (SELECT user_id, event_id, ts, {_SYMBOL} AS role FROM events)
        SELECT event_id, first_value(CASE WHEN role = 'creation' THEN event_id END IGNORE NULLS) OVER w AS creation_id,
          last_value(CASE WHEN role IN ('completed', 'cancelled') THEN event_id END IGNORE NULLS) OVER w AS terminal_id
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def prefix_evidence(spark, d):
    """DM11, WN3-4: the first creation and the latest terminal event up to each event."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", _symbol().alias("role"))
    return S.prefix_evidence(e, "user_id", ["ts", "event_id"], "event_id", "role", ("completed", "cancelled")).select("event_id", "creation_id", "terminal_id")


_HITS = f"""WITH e AS (SELECT user_id, event_id, ts, {_SYMBOL} AS role FROM events), c AS (SELECT user_id, min(ts) AS anchor FROM e WHERE role = 'creation' GROUP BY 1)
        SELECT event_id, user_id FROM e JOIN c USING (user_id) WHERE role = 'trigger' AND epoch_us(ts) BETWEEN epoch_us(anchor) AND epoch_us(anchor) + 604800000000"""


@query("window_hits", _HITS)
def window_hits(spark, d):
    """FLT4: triggers within a week of the user's first creation, both ends included."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), _symbol().alias("role"))
    anchor = e.where("role = 'creation'").groupBy("user_id").agg(F.min("t").alias("a"))
    return e.where("role = 'trigger'").join(anchor, "user_id").where("t between a and a + 604800000000").select("event_id", "user_id")


@query("stream_window_hits", _HITS)
def stream_window_hits(spark, d):
    """SS3: the same windows over a stream, opened by the anchor event and judged when a trigger arrives."""
    events = lambda: stream_table(spark, d, "events").select("user_id", "event_id", "ts", _symbol().alias("role"))
    return run_to_end(lambda: anchored_hits(events(), "user_id", "event_id", "ts", "role", "creation", "trigger", 604_800_000_000), spark)


@query(
    "virtual_times",
    """WITH s AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - epoch(TIMESTAMP '2024-01-01')::BIGINT AS sec FROM events)
       SELECT event_id, printf('D%02d %02d:%02d:%02d', sec // 86400 + 1, sec % 86400 // 3600, sec % 3600 // 60, sec % 60) AS virtual_time, sec AS seconds FROM s""",
)
def virtual_times(spark, d):
    """PRJ21: seconds as virtual time and back."""
    sec = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return table(spark, d, "events").select("event_id", virtual_text(sec).alias("virtual_time")).withColumn("seconds", virtual_seconds(F.col("virtual_time")))


_SEEDS = """seeds AS (SELECT 'n' || n_nationkey AS seed_id, 'src_' || n_nationkey AS trigger_atom_id, 'src_a' || n_nationkey AS lure_1, 'src_b' || n_nationkey AS lure_2,
  CASE n_nationkey % 4 WHEN 0 THEN 'never_created' WHEN 1 THEN 'completed' WHEN 2 THEN 'cancelled' ELSE 'expired' END AS negative_type FROM nation),
dims AS (SELECT * FROM (VALUES ('short', 12, 1, 60), ('medium', 35, 3, 480), ('long', 90, 6, 2880)) t(difficulty, n, nb, minutes), (VALUES ('positive'), ('negative')) b(branch)),
x AS (SELECT *, unnest(range(n)) AS position, n // 2 AS middle, branch = 'negative' AND negative_type <> 'never_created' AS ends FROM seeds, dims),
y AS (SELECT *, CASE WHEN position BETWEEN 2 AND n - 2 AND position <> middle AND NOT (ends AND position = 2)
    THEN position - 1 - CASE WHEN position > middle THEN 1 ELSE 0 END - CASE WHEN ends THEN 1 ELSE 0 END END AS free FROM x),
z AS (SELECT *, CASE WHEN position = n - 1 THEN 'trigger' WHEN position = 0 AND branch = 'negative' AND negative_type = 'never_created' THEN 'background' WHEN position = 0 THEN 'creation'
    WHEN position IN (1, middle) THEN 'lure' WHEN ends AND position = 2 THEN negative_type WHEN free <= nb THEN 'background_intention' ELSE 'background' END AS role,
  CAST(round_even(minutes * 60 * position / (n - 1), 0) AS BIGINT) + 28800 AS sec FROM y)"""


def _seeds(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    kind = F.when(k % 4 == 0, "never_created").when(k % 4 == 1, "completed").when(k % 4 == 2, "cancelled").otherwise("expired")
    return n.select(text("n").alias("seed_id"), text("src_").alias("trigger_atom_id"), text("src_a").alias("lure_1"), text("src_b").alias("lure_2"), kind.alias("negative_type"))


@query(
    "scenario_events",
    f"""WITH {_SEEDS} SELECT seed_id, branch, difficulty, CAST(position AS INTEGER) AS position, role, CASE WHEN position = n - 1 THEN trigger_atom_id WHEN position = 1 THEN lure_1 WHEN position = middle THEN lure_2 END AS atom_id,
        printf('D%02d %02d:%02d:%02d', sec // 86400 + 1, sec % 86400 // 3600, sec % 3600 // 60, sec % 60) AS virtual_time FROM z""",
)
def scenario_events(spark, d):
    """DM7-8: matched logs of each seed that differ in one slot."""
    return S.expand(_seeds(spark, d)).select("seed_id", "branch", "difficulty", "position", "role", "atom_id", "virtual_time")


@query(
    "flip_rate",
    f"""WITH {_SEEDS}, p AS (SELECT seed_id, difficulty, branch, bool_or(role = 'creation') AND NOT bool_or(role IN ('completed', 'cancelled', 'expired')) AS acts FROM z GROUP BY 1, 2, 3),
        q AS (SELECT seed_id, difficulty, count(*) AS n, bool_or(acts) FILTER (branch = 'positive') AS a, bool_or(acts) FILTER (branch = 'negative') AS b FROM p GROUP BY 1, 2)
        SELECT count(*) AS n_pairs, count(*) FILTER (n = 2) AS n_eligible, count(*) FILTER (n = 2 AND a AND NOT b) AS n_flipped, count(*) FILTER (n = 2 AND a AND NOT b) / count(*) FILTER (n = 2) AS flip_rate FROM q""",
)
def flip_rate(spark, d):
    """AG5, DM12, JN8: pairs whose branches decide differently at the trigger."""
    r = run(S.expand(_seeds(spark, d)), REMINDER, "log_id", ["position"], "role", F.floor(F.col("position") / 50))
    last = r.where("role = 'trigger'").withColumn("acts", (F.col("state_before") == "active_unreminded") & (F.col("state_after") == "active_reminded"))
    return S.flips(last, "pair_id", "branch", "acts")


@query(
    "decision_validation",
    f"""WITH RECURSIVE {_FOLD}, k AS (SELECT f.event_id, f.n AS position, e.sym = 'trigger' AND f.state_before = 'active_unreminded' AS acts FROM f JOIN e USING (user_id, n)),
        x AS (SELECT CASE WHEN event_id % 101 = 0 THEN -event_id ELSE event_id END AS event_id, event_id AS decision_id, position + CASE WHEN event_id % 103 = 0 THEN 1 ELSE 0 END AS position, CASE WHEN event_id % 107 = 0 THEN NOT acts ELSE acts END AS acts FROM k)
        SELECT x.decision_id, CASE WHEN k.event_id IS NULL THEN 'current_event' WHEN x.position <> k.position THEN 'observation_trace' WHEN x.acts <> k.acts THEN 'oracle_action' ELSE 'ok' END AS code FROM x LEFT JOIN k ON k.event_id = x.event_id""",
)
def decision_validation(spark, d):
    """VL8, DM13: decisions against the events they name: is the event there, is it the place seen, is the action what its states ask for; faults are planted."""
    seen = _run(spark, d).select("event_id", "user_id", "ts", ((F.col("role") == "trigger") & (F.col("state_before") == "active_unreminded")).alias("acts"))
    rows = ranged(seen, "user_id", ["ts", "event_id"])
    k = running_sum(rows, "user_id", ["ts", "event_id"], F.lit(1), "position").select("event_id", "position", "acts")
    i = F.col("event_id")
    x = k.select(
        F.when(i % 101 == 0, -i).otherwise(i).alias("event_id"), i.alias("decision_id"), (F.col("position") + F.when(i % 103 == 0, 1).otherwise(0)).alias("seen_position"), F.when(i % 107 == 0, ~F.col("acts")).otherwise(F.col("acts")).alias("seen_acts")
    )
    code = F.when(F.col("acts").isNull(), "current_event").when(F.col("seen_position") != F.col("position"), "observation_trace").when(F.col("seen_acts") != F.col("acts"), "oracle_action").otherwise("ok")
    return x.join(k, "event_id", "left").select("decision_id", code.alias("code"))
