"""Problem 9: texts into containers of CAPACITY tokens with little room left over.

Sizes are token counts by a public tokenizer.  A text longer than a container is divided into full
containers and a rest; nothing else is.  Items go to shards of about SHARD_ITEMS by a hash of their
id.  Within a shard a best-fit-decreasing start is improved by local search between underfull
containers: an item moves, or is exchanged for one or for two others, whenever that raises the sum of
the squared fills, until the emptiest container is empty or nothing helps.  The containers that
remain underfull, few from each shard, are taken apart and packed again in fewer shards.

Null and empty texts take no room and are in no container.  A document delivered again is an item
each time.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokenizer
from tidemark.plans.staging import spread, stage

CAPACITY = 2_048
SHARD_ITEMS = 6_000
#: A container filled less than this goes into the second round.
FULL = 0.985
#: Words whose count a task remembers.
CACHE = 1_000_000


def token_counts(documents: DataFrame, folder: str = tokenizer.FOLDER, name: str = tokenizer.BYTE_BPE) -> DataFrame:
    """doc_id, n_tokens of every document; each distinct word is encoded once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = tokenizer.splitter().findall
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                n = 0
                for w in split(text or ""):
                    k = known.get(w)
                    if k is None:
                        if len(known) >= CACHE:
                            known.clear()
                        known[w] = k = len(tokenizer.word_ids(w, folder, name))
                    n += k
                out.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["doc_id", "n_tokens"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, n_tokens int")


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers as lists of item indexes: best fit decreasing, then local search."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in order:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            bisect.insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            bisect.insort(room, (free - sizes[i], b))
    return improve(bins, sizes, capacity)


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Swap-based local search among the containers that have room, until no exchange helps.

    The donor is the emptiest of them that is not known to be of no use.  It gives to another one,
    fullest first: an item as it is, one in exchange for a smaller one or for two together smaller, or
    two for one.  Each step makes a fuller container fuller, so the sum of squared fills rises and the
    search ends by itself.  Two containers that could exchange nothing are not looked at again before
    one of them has changed.
    """
    load = [sum(sizes[i] for i in b) for b in bins]
    version = [0] * len(bins)
    vain: dict[tuple[int, int], tuple[int, int]] = {}
    changed = True
    while changed:
        changed = False
        open_bins = sorted((b for b in range(len(bins)) if bins[b] and load[b] < capacity), key=lambda b: (load[b], b))
        for donor in open_bins:
            for b in reversed(open_bins):
                if b == donor or load[b] < load[donor] or load[b] == capacity or vain.get((donor, b)) == (version[donor], version[b]):
                    continue
                step = _best_step(bins[donor], bins[b], sizes, capacity - load[b])
                while step:
                    gives, takes = step
                    for i in gives:
                        bins[donor].remove(i)
                        bins[b].append(i)
                    for i in takes:
                        bins[b].remove(i)
                        bins[donor].append(i)
                    moved = sum(sizes[i] for i in gives) - sum(sizes[i] for i in takes)
                    load[donor] -= moved
                    load[b] += moved
                    version[donor] += 1
                    version[b] += 1
                    changed = True
                    step = _best_step(bins[donor], bins[b], sizes, capacity - load[b]) if bins[donor] else None
                vain[donor, b] = (version[donor], version[b])
                if not bins[donor]:
                    break
            if changed:
                break
    return [b for b in bins if b]


def _best_step(donor: list[int], other: list[int], sizes: list[int], free: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What the donor gives and takes so that the other container gains most, but no more than it has room."""
    best, step = 0, None
    for i in donor:
        if best < sizes[i] <= free:
            best, step = sizes[i], ((i,), ())
    if best == free:
        return step
    for i in donor:
        for j in other:
            gain = sizes[i] - sizes[j]
            if best < gain <= free:
                best, step = gain, ((i,), (j,))
    if best == free:
        return step
    for x in range(len(other)):
        for y in range(x + 1, len(other)):
            two = sizes[other[x]] + sizes[other[y]]
            for i in donor:
                if best < sizes[i] - two <= free:
                    best, step = sizes[i] - two, ((i,), (other[x], other[y]))
    for x in range(len(donor)):
        for y in range(x + 1, len(donor)):
            two = sizes[donor[x]] + sizes[donor[y]]
            for j in other:
                if best < two - sizes[j] <= free:
                    best, step = two - sizes[j], ((donor[x], donor[y]), (j,))
    return step


def _packed(items: DataFrame, n_shards: int, round_no: int, capacity: int) -> DataFrame:
    """doc_id, piece, offset, n_tokens, container: items packed shard by shard."""

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        container = [""] * len(part)
        for k, b in enumerate(pack(part.n_tokens.tolist(), capacity)):
            for i in b:
                container[i] = f"{round_no}-{part.shard[0]}-{k}"
        return part[["doc_id", "piece", "offset", "n_tokens"]].assign(container=container)

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_no)), F.lit(n_shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(shard, "doc_id bigint, piece int, offset int, n_tokens int, container string")


def containers(documents: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, folder: str = tokenizer.FOLDER) -> DataFrame:
    """container, doc_id, piece, offset, n_tokens: where each piece of each document lies.

    offset: first token of the piece in its document.  Sums of n_tokens of a container are at most
    the capacity.
    """
    counts = stage(token_counts(documents, folder).where("n_tokens > 0"), "p9-counts")
    pieces = counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity))).alias("piece")).select(
        "doc_id", F.col("piece").cast("int"), (F.col("piece") * capacity).cast("int").alias("offset"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("n_tokens")
    )
    whole = pieces.where(F.col("n_tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("0"), F.col("doc_id").cast("string"), F.col("piece").cast("string")))
    rest = pieces.where(F.col("n_tokens") < capacity)
    first = stage(_packed(rest, max(1, -(-rest.count() // shard_items)), 1, capacity), "p9-first")
    fill = first.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    poor = fill.where(F.col("fill") < FULL * capacity).select("container")
    again = stage(first.join(poor, "container", "left_semi").drop("container"), "p9-again")
    second = _packed(again, max(1, -(-again.count() // shard_items)), 2, capacity)
    good = first.join(poor, "container", "left_anti")
    columns = ["container", "doc_id", "piece", "offset", "n_tokens"]
    return whole.select(columns).union(good.select(columns)).union(second.select(columns))


def report(documents: DataFrame) -> DataFrame:
    """n_containers, n_items, n_tokens, unused, share_unused of the packing."""
    packed = containers(documents)
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("n"))
    total = per.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), F.sum("fill").alias("n_tokens"))
    unused = F.col("n_containers") * CAPACITY - F.col("n_tokens")
    return total.withColumn("unused", unused).withColumn("share_unused", unused / (F.col("n_containers") * CAPACITY))


def check(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_documents, n_over, n_split, n_lost, little_room: the packing tested against what it promises.

    Documents that are in some container; containers beyond the capacity; documents divided though they
    would fit; documents whose pieces do not follow each other from 0; less than one per cent unused,
    or less than two containers.
    """
    packed = stage(containers(documents, capacity), "p9-packed")
    fills = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill")).agg(F.count_if(F.col("fill") > capacity).alias("n_over"), F.count("*").alias("n"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"))
    per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("pieces"), F.max("piece").alias("last"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"))
    lost = (F.col("pieces") != F.col("last") + 1) | (F.col("end") != F.col("size"))
    docs = per.agg(F.count("*").alias("n_documents"), F.count_if((F.col("size") <= capacity) & (F.col("pieces") > 1)).alias("n_split"), F.count_if(lost).alias("n_lost"))
    room = F.col("n") * capacity - F.col("tokens")
    return docs.crossJoin(fills).select("n_documents", "n_over", "n_split", "n_lost", ((room < 0.01 * capacity * F.col("n")) | (room < 2 * capacity)).alias("little_room"))


#: doc_id is unique in documents.
CHECK_SQL = "SELECT count(*) AS n_documents, 0 AS n_over, 0 AS n_split, 0 AS n_lost, true AS little_room FROM documents WHERE length(text) > 0"
