"""Structured Streaming twins: the keyed state machine and windowed counts with late data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.automaton import Machine
from tidemark.plans.staging import shared_dir


def machine_stream(events: DataFrame, machine: Machine, key: str, event_id: str, time: str, symbol: str) -> DataFrame:
    """key, event_id, state_before, state_after for a stream of events in the order of time.

    One state value a key.  Inside a micro-batch events of a key are ordered by time and id; an event
    that is older than the last one of its key does not move the machine and comes out with both
    states 'late'.
    """
    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, state_before string, state_after string"

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else (0, None)
        rows = pd.concat(parts).sort_values([time, event_id], kind="stable")
        before, after = [], []
        tables: dict[str, list[int]] = {}
        for at, what in zip(rows[time], rows[symbol]):
            if last is not None and at.value < last:
                before.append("late")
                after.append("late")
                continue
            last = at.value
            table = tables.setdefault(what, machine.table(what)) if what is not None else list(range(len(machine.states)))
            before.append(machine.states[now])
            now = table[now]
            after.append(machine.states[now])
        state.update((int(now), last))
        yield pd.DataFrame({key: keys[0], event_id: rows[event_id].to_numpy(), "state_before": before, "state_after": after})

    return events.groupBy(key).applyInPandasWithState(step, out, "now int, last long", "append", GroupStateTimeout.NoTimeout)


def anchored_hits(events: DataFrame, key: str, event_id: str, time: str, symbol: str, anchor: str, hit: str, width_us: int) -> DataFrame:
    """event_id, key of the hits that lie in the window that opens with the first anchor event of their key, both ends included.

    One state value a key, the time of its anchor: a hit is judged when it arrives, with the anchor that
    came before it, so no event is kept.
    """
    kinds = dict(events.dtypes)

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = state.get[0] if state.exists else None
        rows = pd.concat(parts).sort_values([time, event_id], kind="stable")
        at = rows[time].to_numpy().astype("datetime64[us]").astype("int64")
        out = []
        for t, what, one in zip(at.tolist(), rows[symbol], rows[event_id]):
            if what == anchor and opened is None:
                opened = t
            if what == hit and opened is not None and opened <= t <= opened + width_us:
                out.append(one)
        if opened is not None:
            state.update((opened,))
        yield pd.DataFrame({event_id: out, key: [keys[0]] * len(out)})

    return events.groupBy(key).applyInPandasWithState(step, f"{event_id} {kinds[event_id]}, {key} {kinds[key]}", "opened long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, by: str, width: str, lateness: str) -> DataFrame:
    """window start, by, n: events counted in tumbling windows; rows later than the watermark are dropped."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness)
    return timed.groupBy(F.window("_t", width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


def run_to_end(build: Callable[[], DataFrame], spark: SparkSession, mode: str = "append") -> DataFrame:
    """Drive a stream over everything there is now, into a table in the shared folder; returns that table.

    Input offsets, state and results are in the checkpoint, so a restart goes on where it stopped.
    """
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df = build()
    if mode == "append":
        q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{where}/rows")
    else:
        q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{where}/rows")).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(df.schema).parquet(f"{where}/rows")
