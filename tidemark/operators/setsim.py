"""Exact set-similarity self-join: all pairs with a Jaccard similarity at or above a threshold.

Prefix filter over the global order of tokens by (document frequency, token): two sets whose
similarity reaches the threshold share a token among the first n - ceil(t n) + 1 of each, and the
places of the shared ones bound how many they can share in all.  No pair is approximated away; candidates are verified on the whole sets.

Where the threshold is high (close_pairs) another exact filter needs neither frequencies nor lists of
sets by token: two sets that differ in at most k tokens have at least one of k + 1 parts, into which a
hash puts all tokens, in common as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import forget, merged, release, stage

#: Different tokens whose order travels to every task, sixteen bytes each; more are ordered by a join and a window.
KNOWN = 1_000_000


def _heads_by_join(sized: DataFrame, frequency: DataFrame, prefix: Fraction) -> DataFrame:
    """i, token, at: the first tokens of each set in the global order, by a join with the frequencies and a window."""
    num, den = prefix.numerator, prefix.denominator
    each = sized.select("i", "n", F.explode("set").alias("token"))
    order = F.row_number().over(Window.partitionBy("i").orderBy("df", "token"))
    # ceil(num * n / den) without floating point.
    length = F.col("n") - F.expr(f"({num} * n + {den - 1}) div {den}") + 1
    return each.join(frequency, "token").withColumn("at", order).where(F.col("at") <= length).select("i", "token", "at")


def _heads_by_rank(sized: DataFrame, frequency: DataFrame, prefix: Fraction) -> DataFrame:
    """The same where the tokens are numbers and few are different: each set is ordered where it lies, nothing is shuffled."""
    known = frequency.toArrow()
    token, df = known.column("token").to_numpy(), known.column("df").to_numpy()
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, df))] = np.arange(len(token))
    by_token = np.argsort(token)
    shared = sized.sparkSession.sparkContext.broadcast((token[by_token], rank[by_token], token[np.argsort(rank)]))
    num, den = prefix.numerator, prefix.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks, by_rank = shared.value
        for whole in batches:
            for b in range(0, whole.num_rows, 2_000):
                batch = whole.slice(b, 2_000)
                sets = batch.column(1)
                size = np.diff(sets.offsets.to_numpy())
                of = np.repeat(np.arange(len(size)), size)
                place = ranks[np.searchsorted(tokens, sets.flatten().to_numpy(zero_copy_only=False))]
                place = np.sort(of * len(tokens) + place)  # by row, then by rank
                begin = np.cumsum(size) - size
                at = np.arange(len(of)) - begin[of] + 1
                kept = at <= (size - (num * size + den - 1) // den + 1)[of]
                ids = batch.column(0).to_numpy()[of[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(by_rank[place[kept] - of[kept] * len(tokens)]), pa.array(at[kept].astype(np.int32))], names=["i", "token", "at"])

    return sized.select("i", "set").mapInArrow(run, "i bigint, token bigint, at int")


def set_similarity_pairs(rows: DataFrame, key: str, tokens: str, threshold: str = "0.92", block: list[str] | None = None, differ: str | None = None) -> DataFrame:
    """key_1 < key_2, n_both, n_union: pairs of rows with equal block columns and different `differ`.

    threshold is a decimal in a string and compared as a fraction, so no rounding decides.  rows must
    have one row a key.  Null or empty token sets are in no pair.
    """
    t = Fraction(threshold)
    num, den = t.numerator, t.denominator
    block = block or []
    some = rows.select(F.col(key).alias("k"), *block, *([F.col(differ).alias("_differ")] if differ else []), F.array_distinct(tokens).alias("set")).where(F.size("set") > 0)
    # Read several times below: written once, so that the sets are not made again each time, and with a
    # number that stands for the key, so that the many tokens carry eight bytes each.
    sized = stage(some.withColumn("n", F.size("set")).withColumn("i", F.monotonically_increasing_id()), "sets")
    frequency = stage(sized.select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("df")), "frequency")
    few = frequency.schema["token"].dataType.simpleString() == "bigint" and frequency.count() <= KNOWN
    heads = (_heads_by_rank if few else _heads_by_join)(sized, frequency, t)
    info = sized.select("i", "k", "n", *block, *(["_differ"] if differ else []))
    heads = stage(heads.join(info, "i"), "heads")
    a, b = heads.alias("a"), heads.alias("b")
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.k") < F.col("b.k"))
    for c in block:
        on &= F.col(f"a.{c}") == F.col(f"b.{c}")
    if differ:
        on &= F.col("a._differ") != F.col("b._differ")
    # The sizes alone rule a pair out when the smaller is less than t times the larger.
    on &= (F.col("a.n") * den >= F.col("b.n") * num) & (F.col("b.n") * den >= F.col("a.n") * num)
    met = a.join(b, on).groupBy(F.col("a.i").alias("i1"), F.col("b.i").alias("i2")).agg(
        F.count("*").alias("c"), F.max("a.at").alias("last1"), F.max("b.at").alias("last2"), F.first("a.n").alias("n1"), F.first("b.n").alias("n2")
    )
    # Up to their last shared prefix token the sets share c tokens, behind it at most what is left of either.
    can = F.col("c") + F.least(F.col("n1") - F.col("last1"), F.col("n2") - F.col("last2"))
    met = met.where(can * (den + num) >= (F.col("n1") + F.col("n2")) * num).select("i1", "i2")
    side = lambda x: sized.select(F.col("i").alias(f"i{x}"), F.col("k").alias(f"key_{x}"), F.col("set").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = met.join(side(1), "i1").join(side(2), "i2")
    shared = F.size(F.array_intersect("s1", "s2"))
    counted = both.select("key_1", "key_2", shared.alias("n_both"), (F.col("n1") + F.col("n2") - shared).alias("n_union"))
    return counted.where(F.col("n_both") * den >= F.col("n_union") * num)


#: Pairs whose ids travel to every task, sixteen bytes each.
FEW = 500_000


def _classes(most: int) -> np.ndarray:
    """The least sizes of the classes of sets of up to so many tokens, each a quarter above the one before."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def part_keys(tokens: np.ndarray, size: np.ndarray, block: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key): sets of one block whose similarity reaches t share a key.

    tokens are the different ones of each set, one set after the other.  A pair is met in the class of
    the larger set, so a set has the parts of its own class and of each one that a partner may be in.
    """
    num, den = t.numerator, t.denominator
    least = _classes(int(size.max(initial=1)) * den // num + 1)
    own = np.searchsorted(least, size, side="right") - 1
    which = np.repeat(np.arange(len(size)), size)
    h = _mixed(tokens.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    value = _mixed(h + np.uint64(1))
    out = []
    for c in range(len(least) - 1):
        for up in (0, 1):  # of the class, and of lower ones with partners in it
            there = own == c if not up else (own < c) & (least[c] * num <= size * den)
            if not there.any():
                continue
            k = (den - num) * 2 * (int(least[c + 1]) - 1) // (den + num)
            place = np.cumsum(there) - 1
            mine = there[which]
            part = place[which[mine]] * (k + 1) + (((h[mine] >> np.uint64(32)) * np.uint64(k + 1)) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(int(there.sum()) * (k + 1), np.uint64)
            order = np.argsort(part, kind="stable")
            part, some = part[order], value[mine][order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
            if len(first):
                total[part[first]] = np.add.reduceat(some, first)
            at = np.repeat(np.flatnonzero(there), k + 1)
            salt = np.uint64(c << 32) + np.tile(np.arange(k + 1, dtype=np.uint64), int(there.sum()))
            out.append((at, _mixed(total ^ _mixed(block[at] ^ _mixed(salt + np.uint64(1))))))
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.empty(0, np.int64), np.empty(0, np.uint64))


def close_pairs(rows: DataFrame, key: str, tokens: Column, threshold: str, block: list[str]) -> DataFrame:
    """key_1 < key_2, n_both, n_union: pairs of rows with equal block columns, as set_similarity_pairs; staged.

    For a threshold near one.  rows are staged, with a number as key, one row a key; tokens makes the
    numbers of a row from its columns when they are asked for, so that no sets are written: what is
    shuffled are some twelve bytes for each part of a set.
    """
    t = Fraction(threshold)
    num, den = t.numerator, t.denominator
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in range(0, whole.num_rows, 1_000):
                batch = whole.slice(b, 1_000)
                sets = batch.column(2)
                which, keys = part_keys(sets.flatten().to_numpy(zero_copy_only=False), np.diff(sets.offsets.to_numpy()), batch.column(1).to_numpy().view(np.uint64), t)
                ids = batch.column(0).to_numpy()[which]
                yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(24)).view(np.int64)), pa.array(ids)], names=["part", "i"])

    sets = rows.select(F.col(key).alias("i"), F.xxhash64(*block).alias("b"), F.array_distinct(tokens).alias("set")).where(F.size("set") > 0)
    parts = sets.mapInArrow(run, "part bigint, i bigint")
    a, b = merged(parts).alias("a"), parts.alias("b")
    met = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.i") < F.col("b.i"))).select(F.col("a.i").alias("key_1"), F.col("b.i").alias("key_2")).distinct()
    met = stage(met, "close-met")
    forget(spark)
    wanted = met.select(F.explode(F.array("key_1", "key_2")).alias(key)).distinct()
    few = met.limit(FEW + 1).count() <= FEW
    some = rows.join(F.broadcast(wanted) if few else merged(wanted), key, "left_semi").select(key, *block, F.array_distinct(tokens).alias("set"))
    side = lambda x: some.select(F.col(key).alias(f"key_{x}"), F.struct(*block).alias(f"b{x}"), F.col("set").alias(f"s{x}"))
    both = met.join(merged(side(1)), "key_1").join(merged(side(2)), "key_2").where("b1 = b2")
    shared = F.size(F.array_intersect("s1", "s2"))
    counted = both.select("key_1", "key_2", shared.alias("n_both"), (F.size("s1") + F.size("s2") - shared).alias("n_union"))
    out = stage(counted.where(F.col("n_both") * den >= F.col("n_union") * num), "close")
    release(met)
    return out
