"""Allocation and sampling: quotas, hash-ordered samples, orders over all rows, packing, numbering."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import release, stage


def largest_remainder(counts: DataFrame, keys: list[str], count: str, target: int, tie: str | None = None) -> DataFrame:
    """counts with quota: target shared out in proportion to count by largest remainders.

    Ties of the remainder go to the smaller `tie`, then to the smaller keys; no stratum gets more
    than it has.  The result is empty for an empty table; a target above the total gives every
    stratum its count.  counts has a row for each stratum, few beside the rows they count.
    """
    everything = Window.partitionBy()
    total = F.sum(count).over(everything)
    wanted = F.least(F.lit(target).cast("long"), total)
    share = counts.withColumn("_t", wanted).withColumn("_n", total)
    share = share.withColumn("_base", F.when(F.col("_n") > 0, F.expr(f"{count} * _t div _n")).otherwise(0)).withColumn("_rest", F.expr(f"if(_n > 0, {count} * _t % _n, 0)"))
    left = F.col("_t") - F.sum("_base").over(everything)
    able = (F.col("_base") < F.col(count)).cast("int")
    order = [F.desc("_rest"), *([F.asc(tie)] if tie else []), *[F.asc(k) for k in keys]]
    rank = F.sum(able).over(Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = share.withColumn("_left", left).withColumn("_rank", rank).withColumn("_able", able)
    extra = F.when((F.col("_able") == 1) & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)
    return out.withColumn("quota", F.col("_base") + extra).drop("_t", "_n", "_base", "_rest", "_left", "_rank", "_able")


def hash_order(seed: str, *columns: str | Column) -> Column:
    """SHA-256 of the seed and the columns, separated by NUL: an order that any machine repeats."""
    parts = [F.lit(seed), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def hash_sample(rows: DataFrame, strata: list[str], key: str, seed: str, size: int | Column) -> DataFrame:
    """The first `size` rows of each stratum in hash order, with sample_rank from 1.

    Spark prunes each partition to its own first `size` rows before the shuffle, so a stratum with a
    third of all rows moves few of them.
    """
    order = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(seed, key), key))
    return rows.withColumn("sample_rank", order).where(F.col("sample_rank") <= size)


def quota_sample(rows: DataFrame, strata: list[str], key: str, seed: str, target: int) -> DataFrame:
    """target rows shared out over the strata by largest remainders, in hash order within each."""
    counts = rows.groupBy(*strata).agg(F.count("*").alias("_count"))
    return ranked_by_hash(rows, strata, key, seed, largest_remainder(counts, strata, "_count", target))


def floor_quotas(counts: DataFrame, keys: list[str], count: str, target: int, least: int) -> DataFrame:
    """counts with quota: `least` of each stratum, or all where it has fewer, and what is left by largest remainders.

    Where the floors alone exceed the target, the quotas are the floors.
    """
    floors = counts.withColumn("_least", F.least(F.col(count), F.lit(least))).withColumn("_more", F.col(count) - F.least(F.col(count), F.lit(least)))
    used = counts.agg(F.sum(F.least(F.col(count), F.lit(least)))).first()[0] or 0
    shared = largest_remainder(floors, keys, "_more", max(target - used, 0))
    return shared.withColumn("quota", F.col("quota") + F.col("_least")).drop("_least", "_more")


def ranked_by_hash(rows: DataFrame, strata: list[str], key: str, seed: str, quotas: DataFrame) -> DataFrame:
    """The first `quota` rows of each stratum in hash order, with sample_rank; null strata are strata."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    wanted = quotas.select(*[F.col(s).alias(f"_q_{s}") for s in strata], "quota")
    on = None
    for s in strata:
        same = F.col(s).eqNullSafe(F.col(f"_q_{s}"))
        on = same if on is None else on & same
    # No quota is larger than the largest: with that bound each partition is pruned before the shuffle.
    return hash_sample(rows, strata, key, seed, most).join(wanted, on).where(F.col("sample_rank") <= F.col("quota")).drop(*[f"_q_{s}" for s in strata])


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """rows with their position from 0 in a total order, without one task seeing all rows.

    Rows are range-partitioned and sorted, and each partition begins where the sum of the ones before
    it ends.  `order` must be a total order.  The partitioned rows are written once: borders are
    sampled, and made again they might fall elsewhere.
    """
    ordered = stage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sized = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sized.select("_part", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ordered.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def alternate(rows: DataFrame, order: list[str], ways: int = 2, name: str = "way") -> DataFrame:
    """rows dealt out in turn to so many ways in a total order."""
    return numbered(rows, order, "_position").withColumn(name, F.pmod("_position", F.lit(ways)).cast("int")).drop("_position")


#: FIXED VALUES: rows of a shard, shards of a task, tasks of each wave.
SHARD_ROWS, SHARDS_PER_TASK, WAVES = 500, 10, (1, 10, 10, 10, 10, 10, 10, 14)


def shard_numbers(position: Column, shard_rows: int = SHARD_ROWS, shards_per_task: int = SHARDS_PER_TASK, waves: tuple[int, ...] = WAVES) -> tuple[Column, Column, Column]:
    """(shard, task, wave) of a position; waves hold so many tasks each, later tasks are in the last."""
    shard = F.floor(position / shard_rows)
    task = F.floor(shard / shards_per_task)
    wave, end = F.lit(None).cast("int"), 0
    for number, tasks in enumerate(waves):
        end += tasks
        wave = F.coalesce(wave, F.when(task < end, F.lit(number)))
    return shard, task, F.coalesce(wave, F.lit(len(waves) - 1))


def greedy_packages(rows: DataFrame, shard: str, order: str, size: str, max_items: int = 5, max_size: int = 12_000) -> DataFrame:
    """rows with package (from 0 in each shard): filled in order up to max_items and max_size.

    An item larger than max_size is alone and marked oversize.  The work is sequential in a shard,
    whose number of rows the caller bounds (see shard_numbers).
    """
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("package", T.IntegerType()), T.StructField("oversize", T.BooleanType())])

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        package, number, items, total = [], -1, max_items, 0
        for s in part[size].fillna(0):
            if items >= max_items or total + s > max_size:
                number, items, total = number + 1, 0, 0
            items, total = items + 1, total + s
            package.append(number)
        return part.assign(package=pd.Series(package, dtype="int32"), oversize=part[size].fillna(0) > max_size)

    return rows.groupBy(shard).applyInPandas(pack, schema)


#: The sequential allocation below is for component lists that a person could read.
COMPONENT_LIMIT = 100_000


def allocate_by_deficit(components: DataFrame, key: str, size: str, labels: tuple[str, ...], ratios: tuple[float, ...], seed: int) -> DataFrame:
    """key, split: components in a seeded shuffle, each to the label that lacks most rows.

    Each decision depends on all before it, so the list is folded on the driver; more than
    COMPONENT_LIMIT components are refused (the bundled allocation of the llm subpackage has no such
    bound).  The shuffle is that of Python's generator over the sorted keys.
    """
    spark = components.sparkSession
    rows = components.select(key, size).orderBy(key).limit(COMPONENT_LIMIT + 1).collect()
    if len(rows) > COMPONENT_LIMIT:
        raise ValueError(f"more than {COMPONENT_LIMIT} components")
    sizes = {r[0]: r[1] for r in rows}
    keys = list(sizes)
    random.Random(seed).shuffle(keys)
    total = sum(sizes.values())
    have = dict.fromkeys(labels, 0)
    chosen = []
    for k in keys:
        lack = {label: total * ratio - have[label] for label, ratio in zip(labels, ratios)}
        label = max(labels, key=lambda x: (lack[x], -labels.index(x)))
        if lack[label] <= 0:
            label = min(labels, key=lambda x: (have[x] / ratios[labels.index(x)] if ratios[labels.index(x)] else float("inf"), labels.index(x)))
        have[label] += sizes[k]
        chosen.append((k, label))
    return spark.createDataFrame(chosen, f"{key} {components.schema[key].dataType.simpleString()}, split string")


def greedy_disjoint(rows: DataFrame, key: str, order: list[str], items: str) -> DataFrame:
    """Rows accepted in order, skipping each that shares an item with an accepted one before it.

    Decided in rounds instead of one after the other: a row is accepted once every earlier row that
    shares an item with it is rejected, and rejected once one of these is accepted.  Each round looks
    only at the first undecided row of each item; every round decides at least the first of all.
    """
    ranked = numbered(rows.select(key, *order, items), [*order, key], "_rank").select(key, "_rank", F.explode(items).alias("_item"))
    open_rows = stage(ranked.distinct(), "disjoint")
    accepted = None
    while not open_rows.isEmpty():
        first = open_rows.groupBy("_item").agg(F.min("_rank").alias("_first"))
        # First everywhere: nothing before it is undecided on any of its items.
        judged = open_rows.join(first, "_item").groupBy(key, "_rank").agg(F.min((F.col("_rank") == F.col("_first")).cast("int")).alias("_ok"))
        winners = stage(judged.where("_ok = 1").select(key, "_rank"), "disjoint-won")
        accepted = winners if accepted is None else accepted.union(winners)
        used = open_rows.join(winners.select("_rank"), "_rank", "left_semi").select("_item").distinct()
        gone = open_rows.join(used, "_item", "left_semi").select("_rank").distinct()
        before, open_rows = open_rows, stage(open_rows.join(gone, "_rank", "left_anti"), "disjoint")
        release(before)
    return (accepted if accepted is not None else ranked.select(key, "_rank").limit(0)).select(key)
