"""Expansion of seeds into matched event logs that differ in one place, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import virtual_text
from tidemark.operators.prefix import PART, first_or_last, ranged

BRANCHES = ("positive", "negative")


@dataclass(frozen=True)
class Difficulty:
    """Number of events, of independent intentions among them, and minutes from the first to the last."""

    name: str
    n_events: int
    n_background: int
    minutes: int


#: FIXED VALUES: the three difficulties.
DIFFICULTIES = (Difficulty("short", 12, 1, 60), Difficulty("medium", 35, 3, 480), Difficulty("long", 90, 6, 2880))


def expand(seeds: DataFrame, difficulties: tuple[Difficulty, ...] = DIFFICULTIES) -> DataFrame:
    """seed_id, branch, difficulty, log_id, pair_id, position, role, atom_id, virtual_time: all logs' events.

    seeds: seed_id, trigger_atom_id, lure_1, lure_2, negative_type.  Slots: 0 creation; 1 and the
    middle the lures; 2, or 3 where the middle is 2, the terminal event of a negative branch; last the
    trigger; the first free ones independent intentions; the rest background.  A negative branch of
    the type never_created has background in slot 0.  Virtual times are evenly spaced from 08:00 of
    the first day, rounded half to even.
    """
    spark = seeds.sparkSession
    plan = []
    for x in difficulties:
        middle = x.n_events // 2
        terminal = 3 if middle == 2 else 2
        for branch in BRANCHES:
            free = [p for p in range(1, x.n_events - 1) if p not in (1, middle)]
            plan.append((x.name, branch, x.n_events, x.n_background, x.minutes, middle, terminal, free))
    dims = F.broadcast(spark.createDataFrame(plan, "difficulty string, branch string, n int, n_background int, minutes int, middle int, terminal int, free array<int>"))
    each = seeds.join(dims, F.lit(True)).withColumn("position", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    negative = F.col("branch") == "negative"
    ends = negative & F.col("negative_type").isin("completed", "cancelled", "expired")
    # The terminal slot is not free, so the independent intentions move on by one behind it.
    free_place = F.array_position(F.filter("free", lambda p: ~(ends & (p == F.col("terminal")))), F.col("position"))
    role = (
        F.when(F.col("position") == F.col("n") - 1, "trigger")
        .when((F.col("position") == 0) & negative & (F.col("negative_type") == "never_created"), "background")
        .when(F.col("position") == 0, "creation")
        .when(F.col("position").isin(1) | (F.col("position") == F.col("middle")), "lure")
        .when(ends & (F.col("position") == F.col("terminal")), F.col("negative_type"))
        .when((free_place > 0) & (free_place <= F.col("n_background")), "background_intention")
        .otherwise("background")
    )
    atom = F.when(F.col("position") == F.col("n") - 1, F.col("trigger_atom_id")).when(F.col("position") == 1, F.col("lure_1")).when(F.col("position") == F.col("middle"), F.col("lure_2"))
    seconds = F.bround(F.col("minutes") * 60 * F.col("position") / (F.col("n") - 1), 0).cast("long") + 8 * 3600
    return each.select(
        "seed_id",
        "branch",
        "difficulty",
        F.concat_ws("_", F.lit("log"), "seed_id", "branch", "difficulty").alias("log_id"),
        F.concat_ws("_", F.lit("cf"), "seed_id", "difficulty").alias("pair_id"),
        "position",
        role.alias("role"),
        atom.alias("atom_id"),
        virtual_text(seconds).alias("virtual_time"),
    )


def decision_type(role: Column, state_before: Column) -> Column:
    """trigger, a kind of lure by the state it meets, or ordinary silence."""
    lure = F.when(state_before == "completed", "post_completion_lure").when(state_before == "cancelled", "post_cancellation_lure").when(state_before == "expired", "post_expiry_lure").when(state_before == "active_reminded", "already_reminded_lure").otherwise("non_trigger_lure")
    return F.when(role == "trigger", "trigger").when(role == "lure", lure).otherwise("ordinary_silence")


def prefix_evidence(events: DataFrame, key: str, order: list[str], event_id: str, role: str, terminal: tuple[str, ...]) -> DataFrame:
    """events with creation_id (first creation so far) and terminal_id (latest terminal event so far).

    Only the prefix up to the event itself is looked at; a key with very many events is several tasks.
    """
    rows = ranged(events, key, order)
    rows = first_or_last(rows, key, order, F.when(F.col(role) == "creation", F.col(event_id)), "creation_id", last=False)
    return first_or_last(rows, key, order, F.when(F.col(role).isin(*terminal), F.col(event_id)), "terminal_id", last=True).drop(PART)


def flips(decisions: DataFrame, pair: str, branch: str, acts: str) -> DataFrame:
    """n_pairs, n_eligible, n_flipped, flip_rate: pairs with one decision a branch, and those that differ as they should.

    decisions has a row for each branch of a pair; acts is a boolean.  The rate is null without
    eligible pairs.
    """
    per = decisions.groupBy(pair).agg(
        F.count("*").alias("n"),
        F.countDistinct(branch).alias("branches"),
        F.max(F.when(F.col(branch) == "positive", F.col(acts).cast("int"))).alias("p"),
        F.max(F.when(F.col(branch) == "negative", F.col(acts).cast("int"))).alias("q"),
    )
    eligible = (F.col("n") == 2) & (F.col("branches") == 2)
    out = per.agg(F.count("*").alias("n_pairs"), F.count_if(eligible).alias("n_eligible"), F.count_if(eligible & (F.col("p") == 1) & (F.col("q") == 0)).alias("n_flipped"))
    return out.withColumn("flip_rate", F.try_divide("n_flipped", "n_eligible"))
