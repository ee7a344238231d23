"""Keyed finite-state machines over ordered events, as a parallel prefix.

The effect of a run of events on every possible state is a small table, and such tables compose.  So
the events of a key are folded inside time buckets, the buckets' tables are composed in order, and
each bucket is walked once more from its true start.  No key needs to fit into one task; only a
bucket does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Machine:
    """States by number, the first is the start; moves (state, symbol) -> state; others stay or fail.

    A symbol of `strict` without a move leads to the state `failed`, which nothing leaves; any other
    symbol without a move changes nothing.
    """

    states: tuple[str, ...]
    moves: dict[tuple[str, str], str]
    strict: frozenset[str] = frozenset()
    failed: str | None = None

    def table(self, symbol: str) -> list[int]:
        """Where a symbol leads from each state."""
        out = []
        for i, s in enumerate(self.states):
            if s == self.failed:
                out.append(i)
            elif (s, symbol) in self.moves:
                out.append(self.states.index(self.moves[s, symbol]))
            else:
                out.append(self.states.index(self.failed) if symbol in self.strict and self.failed else i)
        return out

    def tables(self, symbol: Column) -> Column:
        """Column form of table()."""
        names = sorted({s for _, s in self.moves} | self.strict)
        same = F.array(*[F.lit(i) for i in range(len(self.states))])
        out = same
        for name in names:
            out = F.when(symbol == name, F.array(*[F.lit(i) for i in self.table(name)])).otherwise(out)
        return out

    def name(self, number: Column) -> Column:
        """Name of a state's number."""
        return F.element_at(F.array(*[F.lit(s) for s in self.states]), number + 1)


def _compose(first: Column, then: Column) -> Column:
    """The table of first and then the other."""
    return F.transform(first, lambda i: F.element_at(then, i + 1))


def run(events: DataFrame, machine: Machine, key: str, order: list[str], symbol: str, bucket: Column) -> DataFrame:
    """events with state_before and state_after, names of states.

    order: columns that order the events of a key totally; bucket: an integer that does not fall with
    that order, which bounds the rows of one key in one task.  Rows with a null key or bucket are left
    out; a null symbol changes nothing.
    """
    keep = [c for c in events.columns if c not in (key, *order, symbol)]
    rows = events.withColumn("_b", bucket).where(F.col(key).isNotNull() & F.col("_b").isNotNull())
    step = F.struct(*order, F.col(symbol).alias("_symbol"), F.struct(*[F.col(c) for c in keep]).alias("_keep") if keep else F.lit(0).alias("_keep"))
    lists = rows.groupBy(F.col(key).alias("_k"), "_b").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    same = F.array(*[F.lit(i) for i in range(len(machine.states))])
    effect = F.aggregate("steps", same, lambda acc, s: _compose(acc, machine.tables(s["_symbol"])))
    effects = lists.select("_k", "_b", effect.alias("effect"))
    # One row for each bucket of a key; walked in order to the state at each bucket's start.
    walked = effects.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_b", "effect"))).alias("bs"))
    starts = F.aggregate(
        "bs",
        F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<b:bigint,state:int>>").alias("out")),
        lambda acc, x: F.struct(F.element_at(x["effect"], acc["state"] + 1).alias("state"), F.concat(acc["out"], F.array(F.struct(x["_b"].cast("bigint").alias("b"), acc["state"].alias("state")))).alias("out")),
        lambda acc: acc["out"],
    )
    begun = walked.select("_k", F.explode(starts).alias("x")).select(F.col("_k").alias("_k2"), F.col("x.b").alias("_b2"), F.col("x.state").alias("_start"))
    inside = F.aggregate(
        "steps",
        F.struct(F.col("_start").alias("state"), F.array().cast("array<int>").alias("out")),
        lambda acc, s: F.struct(F.element_at(machine.tables(s["_symbol"]), acc["state"] + 1).alias("state"), F.concat(acc["out"], F.array(F.element_at(machine.tables(s["_symbol"]), acc["state"] + 1))).alias("out")),
        lambda acc: acc["out"],
    )
    joined = lists.join(begun, (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2"))).withColumn("after", inside)
    before = F.concat(F.array("_start"), F.slice("after", 1, F.greatest(F.size("after") - 1, F.lit(0))))
    each = joined.select("_k", F.explode(F.arrays_zip("steps", before.alias("before"), "after")).alias("x"))
    return each.select(
        F.col("_k").alias(key),
        *[F.col(f"x.steps.{o}").alias(o) for o in order],
        F.col("x.steps._symbol").alias(symbol),
        *[F.col(f"x.steps._keep.{c}").alias(c) for c in keep],
        machine.name(F.col("x.before")).alias("state_before"),
        machine.name(F.col("x.after")).alias("state_after"),
    )


#: FIXED VALUES: the states and moves of a reminder's life: created once, then completed, cancelled, expired or reminded, each once.
REMINDER = Machine(
    states=("never_created", "active_unreminded", "active_reminded", "completed", "cancelled", "expired", "illegal"),
    moves={
        ("never_created", "creation"): "active_unreminded",
        ("active_unreminded", "completed"): "completed",
        ("active_unreminded", "cancelled"): "cancelled",
        ("active_unreminded", "expired"): "expired",
        ("active_unreminded", "trigger"): "active_reminded",
    },
    strict=frozenset({"creation", "completed", "cancelled", "expired"}),
    failed="illegal",
)
