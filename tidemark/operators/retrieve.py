"""Retrieval: exact top-k in blocks, rank fusion, constrained picks, survivors, reservoirs, clusters."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import release, stage

BLOCK = 4_096


def _blocked(df: DataFrame, key: str, name: str, block: int) -> tuple[DataFrame, int]:
    n = max(1, math.ceil(df.count() / block))
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def dense_topk(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, <key>, score, rank: the k corpus rows with the largest inner product of each query but itself.

    Exact: every block of queries meets every block of the corpus as one matrix product, keeps its own
    k best, and the blocks' lists are merged.  Ties go to the smaller key.  Null vectors take no part.
    """
    q, nq = _blocked(queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q")).where("q is not null"), "query_id", "qb", block)
    c, nc = _blocked(corpus.select(F.col(key).alias("id"), F.col(vector).alias("c")).where("c is not null"), "id", "cb", block)
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    kind = corpus.schema[key].dataType.simpleString()

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        ids = right.id.to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        s = np.stack(left.q.to_numpy()).astype(np.float64) @ np.stack(right.c.to_numpy()).astype(np.float64)[order].T
        rows = []
        for i, one in enumerate(left.query_id.to_numpy()):
            at = np.argsort(-s[i], kind="stable")[: k + 1]  # one more, for itself
            at = at[ids[at] != one][:k]
            rows.append(pd.DataFrame({"query_id": one, "id": ids[at], "score": s[i, at]}))
        return pd.concat(rows)

    best = q.groupBy("qb", "cb").cogroup(c.select("id", "c", F.col("qb").alias("qb2"), F.col("cb").alias("cb2")).groupBy("qb2", "cb2")).applyInPandas(score, f"query_id {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", key)


def sparse_topk(queries: DataFrame, corpus: DataFrame, key: str, weights: str, k: int) -> DataFrame:
    """query_id, <key>, score, rank by the inner product of non-negative sparse weights (maps).

    An inverted index joined on the token.  Rows that share no token score 0 and are ranked too, by
    key; only the k smallest keys can be needed for that.
    """
    q = queries.select(F.col(key).alias("query_id"), F.explode(weights).alias("token", "wq"))
    c = corpus.select(F.col(key).alias("id"), F.explode(weights).alias("token", "wc"))
    scored = q.join(c, "token").where("query_id <> id").groupBy("query_id", "id").agg(F.sum(F.col("wq") * F.col("wc")).alias("score"))
    pads = F.broadcast(corpus.select(F.col(key).alias("id")).orderBy("id").limit(k + 1))
    zero = queries.select(F.col(key).alias("query_id")).join(pads, F.col("query_id") != F.col("id")).join(scored, ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.unionByName(zero).withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", key)


def fused(a: DataFrame, b: DataFrame, key: str, k: int = 60) -> DataFrame:
    """query_id, <key>, rank_a, rank_b, rrf_exact, rrf_score, rank: reciprocal-rank fusion of two ranked lists.

    Scores are decimals wide enough to order any two sums of reciprocals of ranks below 1,000 exactly.
    """
    part = lambda df, name: df.select("query_id", key, F.col("rank").alias(name))
    both = part(a, "rank_a").join(part(b, "rank_b"), ["query_id", key], "full_outer")
    scored = both.withColumn("_exact", F.expr(f"cast(coalesce(cast(1 as decimal(30,24)) / cast(rank_a + {k} as decimal(6,0)), 0) + coalesce(cast(1 as decimal(30,24)) / cast(rank_b + {k} as decimal(6,0)), 0) as decimal(38,24))"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_exact"), key))
    return scored.withColumn("rrf_score", F.col("_exact").cast("double")).withColumn("rank", rank).withColumnRenamed("_exact", "rrf_exact")


def constrained_pick(ranked: DataFrame, query: str, rank: str, same: Column, n: int) -> DataFrame:
    """ranked with pick (from 1): per query the best row that is `same`, the best that is not, then by rank.

    Queries that have not both are left out.
    """
    first = F.row_number().over(Window.partitionBy(query, "_same").orderBy(rank))
    flagged = ranked.withColumn("_same", same).withColumn("_first", first)
    order = F.when((F.col("_first") == 1) & F.col("_same"), 0).when(F.col("_first") == 1, 1).otherwise(2)
    pick = F.row_number().over(Window.partitionBy(query).orderBy(order, rank))
    kinds = F.size(F.collect_set("_same").over(Window.partitionBy(query)))
    return flagged.withColumn("pick", pick).withColumn("_kinds", kinds).where((F.col("_kinds") == 2) & (F.col("pick") <= n)).drop("_same", "_first", "_kinds")


def near_in_cluster(rows: DataFrame, key: str, cluster: str, vector: str, at_most: float, block: int = BLOCK, closest: bool = False) -> DataFrame:
    """<cluster>, id_1 < id_2, distance: pairs of a cluster within the cosine distance, block against block.

    Distances are 1 - inner product in double precision, clipped, compared as float32.  closest: only the
    nearest pair of each two blocks.
    """
    kind, group = rows.schema[key].dataType.simpleString(), rows.schema[cluster].dataType.simpleString()
    sizes = rows.groupBy(cluster).agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    some = rows.select(F.col(cluster).alias("g"), F.col(key).alias("id"), F.col(vector).alias("v")).where("v is not null").join(sizes.withColumnRenamed(cluster, "g"), "g")
    blocked = some.withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    left = blocked.withColumn("o", F.explode(F.sequence("b", F.col("nb") - 1))).select("g", F.col("b").alias("x"), F.col("o").alias("y"), "id", "v")
    right = blocked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b")))).select(F.col("g").alias("g2"), F.col("o").alias("x2"), F.col("b").alias("y2"), F.col("id").alias("id2"), F.col("v").alias("v2"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"g": [], "id_1": [], "id_2": [], "distance": []})
        s = np.stack(a.v.to_numpy()).astype(np.float64) @ np.stack(b.v2.to_numpy()).astype(np.float64).T
        d = (1 - np.clip(s, -1, 1)).astype(np.float32)
        i, j = np.nonzero(d <= np.float32(at_most))
        x, y = a.id.to_numpy()[i], b.id2.to_numpy()[j]
        # Within a block each pair is met twice, across blocks once.
        inside = a.x.iloc[0] == a.y.iloc[0]
        keep = (x < y) if inside else (x != y)
        x, y, d = x[keep], y[keep], d[i, j][keep]
        if closest and len(d):
            x, y, d = (z[[int(np.argmin(d))]] for z in (x, y, d))
        return pd.DataFrame({"g": a.g.iloc[0], "id_1": np.minimum(x, y) if x.dtype != object else [min(p) for p in zip(x, y)], "id_2": np.maximum(x, y) if x.dtype != object else [max(p) for p in zip(x, y)], "distance": d})

    out = left.groupBy("g", "x", "y").cogroup(right.groupBy("g2", "x2", "y2")).applyInPandas(near, f"g {group}, id_1 {kind}, id_2 {kind}, distance float")
    return out.withColumnRenamed("g", cluster)


def survivors(rows: DataFrame, key: str, order: list[str], pairs: DataFrame) -> DataFrame:
    """<key>, survives: greedy suppression in a total order, decided in rounds.

    A row is suppressed when an earlier survivor is its neighbour in pairs (id_1, id_2).  A row whose
    earlier neighbours are all suppressed survives; one with a surviving earlier neighbour does not.
    Each round decides at least the earliest open row, usually nearly all, and none needs a cluster in
    one task.
    """
    from tidemark.operators.allocate import numbered

    ranked = stage(numbered(rows.select(key, *[o for o in order if o != key]), [*order, *([] if key in order else [key])], "_rank").select(F.col(key).alias("k"), "_rank"), "rank")
    a = ranked.select(F.col("k").alias("id_1"), F.col("_rank").alias("r1"))
    b = ranked.select(F.col("k").alias("id_2"), F.col("_rank").alias("r2"))
    edges = stage(pairs.select("id_1", "id_2").join(a, "id_1").join(b, "id_2").select(F.least("r1", "r2").alias("early"), F.greatest("r1", "r2").alias("late")).distinct(), "edges")
    suppressed = None
    while not edges.isEmpty():
        # Without an open earlier neighbour: survives.
        sure = edges.select(F.col("early").alias("r")).distinct().join(edges.select(F.col("late").alias("r")).distinct(), "r", "left_anti")
        out = stage(edges.join(sure.withColumnRenamed("r", "early"), "early", "left_semi").select(F.col("late").alias("r")).distinct(), "suppressed")
        suppressed = out if suppressed is None else suppressed.union(out)
        rest = edges.join(sure.withColumnRenamed("r", "early"), "early", "left_anti")
        rest = rest.join(out.withColumnRenamed("r", "early"), "early", "left_anti").join(out.withColumnRenamed("r", "late"), "late", "left_anti")
        before, edges = edges, stage(rest, "edges")
        release(before)
    if suppressed is None:
        return ranked.select(F.col("k").alias(key), F.lit(True).alias("survives"))
    gone = suppressed.select(F.col("r").alias("_rank"), F.lit(False).alias("s"))
    return ranked.join(gone, "_rank", "left").select(F.col("k").alias(key), F.coalesce("s", F.lit(True)).alias("survives"))


def _away(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 - inner product of each row with x, row by row: the same to the last bit however many rows there are."""
    return 1 - (v * x).sum(axis=1)


def _farthest(ids: np.ndarray, v: np.ndarray, centre: np.ndarray, size: int) -> list[int]:
    """Indexes of the row nearest to the centre, then always the one farthest from all chosen."""
    order = np.argsort(ids, kind="stable")
    v = np.ascontiguousarray(v[order])
    chosen = [int(np.argmin(_away(v, centre)))]
    far = _away(v, v[chosen[0]])
    while len(chosen) < min(size, len(v)):
        far[chosen[-1]] = -np.inf
        i = int(np.argmax(far))
        chosen.append(i)
        far = np.minimum(far, _away(v, v[i]))
    return [int(order[i]) for i in chosen]


def _farthest_in_rounds(rows: DataFrame, centres: dict, size: int, schema: str) -> list[tuple]:
    """(g, id, place) of the same rows as _farthest, of clusters that are too large for one task.

    In each round every batch of rows reports the best row of each cluster, given the rows chosen so
    far, and the best report is chosen.  The driver holds the chosen rows only.
    """
    chosen: dict = {g: [] for g in centres}
    out = []
    for place in range(1, size + 1):

        def report(batches, chosen=chosen, first=place == 1):
            for x in batches:
                for g, part in x.groupby("g"):
                    ids, v = part.id.to_numpy(), np.ascontiguousarray(np.stack(part.v.to_numpy()).astype(np.float64))
                    if first:
                        score = -_away(v, np.asarray(centres[g], np.float64))
                    else:
                        score = np.minimum.reduce([_away(v, c) for _, c in chosen[g]])
                        score[np.isin(ids, [i for i, _ in chosen[g]])] = -np.inf
                    at = np.flatnonzero(score == score.max())
                    best = at[np.argsort(ids[at], kind="stable")[0]]
                    if score[best] > -np.inf:
                        yield pd.DataFrame({"g": [g], "id": [ids[best]], "v": [part.v.iloc[best]], "score": [score[best]]})

        reports = rows.mapInPandas(report, f"{schema}, score double").withColumn("id_", F.col("id"))
        best = reports.groupBy("g").agg(F.min_by(F.struct("id", "v"), F.struct((-F.col("score")).alias("s"), F.col("id_"))).alias("x"))
        for r in best.collect():
            chosen[r.g].append((r.x.id, np.asarray(r.x.v, np.float64)))
            out.append((r.g, r.x.id, place))
    return out


def reservoirs(rows: DataFrame, key: str, cluster: str, vector: str, size: int = 64, block: int = BLOCK) -> DataFrame:
    """<cluster>, <key>, place: a diverse reservoir of each cluster, farthest first.

    A cluster of at most block rows is one task; for larger ones every place is a round over all their
    rows, with the same result, so a cluster of any size is never in one task.
    """
    kind, group = rows.schema[key].dataType.simpleString(), rows.schema[cluster].dataType.simpleString()
    some = rows.select(F.col(cluster).alias("g"), F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")).where("v is not null and g is not null")
    means = some.select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c"))
    centres = means.select("g", F.transform("c", lambda x: x["m"]).alias("centre"))
    per = stage(some.groupBy("g").agg(F.count("*").alias("n")).join(centres, "g"), "clusters")

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        chosen = _farthest(part.id.to_numpy(), np.stack(part.v.to_numpy()).astype(np.float64), np.asarray(part.centre.iloc[0], dtype=np.float64), size)
        return part.iloc[chosen].assign(place=np.arange(1, len(chosen) + 1, dtype=np.int32))[["g", "id", "place"]]

    small = some.join(per.where(F.col("n") <= block), "g").groupBy("g").applyInPandas(pick, f"g {group}, id {kind}, place int")
    large = {r.g: r.centre for r in per.where(F.col("n") > block).collect()}
    if large:
        wide = stage(some.join(per.where(F.col("n") > block).select("g"), "g", "left_semi"), "large-clusters")
        places = _farthest_in_rounds(wide, large, size, f"g {group}, id {kind}, v array<float>")
        small = small.union(rows.sparkSession.createDataFrame(places, f"g {group}, id {kind}, place int"))
    return small.select(F.col("g").alias(cluster), F.col("id").alias(key), "place")


def survivor_spacing(rows: DataFrame, key: str, cluster: str, vector: str, kept: DataFrame) -> DataFrame:
    """<cluster>, n_survivors, min_distance: the smallest cosine distance between two kept rows of a cluster.

    kept: <key>, survives.  Every pair of survivors is looked at, whatever their distance; min_distance is
    null for a single survivor.
    """
    alive = stage(rows.select(key, cluster, vector).join(kept.where("survives").select(key), key), "alive")
    pairs = near_in_cluster(alive, key, cluster, vector, 2.0, closest=True)
    least = pairs.groupBy(cluster).agg(F.min("distance").alias("min_distance"))
    return alive.groupBy(cluster).agg(F.count("*").alias("n_survivors")).join(least, cluster, "left")


def projected(rows: DataFrame, vector: str, size: int, seed: int = 20260910) -> DataFrame:
    """rows with the vector replaced by its sparse random projection to `size`, normalised again."""
    from pyspark.sql import types as T

    schema = T.StructType([f if f.name != vector else T.StructField(vector, T.ArrayType(T.FloatType())) for f in rows.schema.fields])

    def run(batches):
        matrix = None
        for batch in batches:
            good = batch[vector].notna().to_numpy()
            if good.any():
                v = np.stack(batch[vector][good].to_numpy()).astype(np.float64)
                if matrix is None:
                    n = v.shape[1]
                    rng = np.random.default_rng(seed)
                    matrix = np.where(rng.random((n, size)) < 1 / math.sqrt(n), np.sign(rng.random((n, size)) - 0.5), 0.0) * math.sqrt(math.sqrt(n) / size)
                p = v @ matrix
                length = np.linalg.norm(p, axis=1, keepdims=True)
                p = np.where(length > 0, p / np.where(length > 0, length, 1), 0).astype(np.float32)
                values = np.full(len(batch), None, dtype=object)
                values[np.flatnonzero(good)] = list(p)
                batch = batch.assign(**{vector: values})
            yield batch

    return rows.mapInPandas(run, schema)


def canonical_names(centres: np.ndarray) -> list[int]:
    """For each centre its rank by the SHA-256 of its float32 bytes; negative zeros count as zero, what is no number is refused."""
    c = np.asarray(centres, dtype="<f4") + np.float32(0)
    if not np.isfinite(c).all():
        raise ValueError("a centre that is not a number")
    digests = [hashlib.sha256(np.where(x == 0, np.float32(0), x).astype("<f4").tobytes()).hexdigest() for x in c]
    order = sorted(range(len(digests)), key=lambda i: digests[i])
    return [order.index(i) for i in range(len(order))]


def clustered(rows: DataFrame, key: str, vector: str, k: int, seed: int = 20260829) -> DataFrame:
    """<key>, cluster: k-means by Spark ML; a cluster's id is the rank of its centre's SHA-256.

    The algorithm is Spark's, so its clusters are like, not equal to, those of another implementation.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = rows.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(ready)
    names = F.array(*[F.lit(x) for x in canonical_names(np.array(model.clusterCenters()))])
    return model.transform(ready).select(key, F.get(names, F.col("prediction")).alias("cluster"))


# FIXED VALUES of the mini-batch clustering.
SAMPLE, BATCH, STARTS, EPOCHS, PATIENCE, SEED = 65_536, 8_192, 3, 20, 30, 20260910


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, squared distance to it) of each row."""
    d = (v * v).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(axis=1)[None, :]
    near = d.argmin(axis=1)
    return near, np.maximum(d[np.arange(len(v)), near], 0)


def minibatch_centres(v: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Centres of mini-batch k-means: the best of STARTS k-means++ seedings, then batches until none improves for long."""
    rng = np.random.default_rng(seed)
    starts = []
    for _ in range(STARTS):
        some = v[rng.choice(len(v), min(len(v), max(BATCH, k)), replace=False)]
        centres = some[rng.integers(len(some))][None, :]
        for _ in range(k - 1):  # k-means++: the farther a row is from all centres, the likelier it is the next
            far = _nearest(some, centres)[1]
            at = rng.choice(len(some), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(some))
            centres = np.vstack([centres, some[at]])
        starts.append((_nearest(some, centres)[1].sum(), len(starts), centres))
    centres = min(starts)[2].copy()
    count = np.zeros(k)
    smooth, best, idle = None, np.inf, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(v))
        for b in range(0, len(v), BATCH):
            part = v[order[b : b + BATCH]]
            near, far = _nearest(part, centres)
            for c in np.unique(near):
                own = part[near == c]
                count[c] += len(own)
                centres[c] += (own.sum(axis=0) - len(own) * centres[c]) / count[c]
            share = min(2 * len(part) / (len(v) + 1), 1)
            smooth = far.mean() if smooth is None else smooth * (1 - share) + far.mean() * share
            idle = 0 if smooth < best else idle + 1
            best = min(best, smooth)
            if idle >= PATIENCE:
                return centres
    return centres


def minibatch_clustered(rows: DataFrame, key: str, vector: str, k: int, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """<key>, cluster by mini-batch k-means: fitted on at most `sample` rows in hash order, assigned to all rows.

    The bound of the sample is a parameter; what the driver and every task hold are the sample and the
    k centres.  Rows without a vector are in no cluster; with fewer rows than k, k is their number.
    """
    from tidemark.operators.allocate import hash_order

    kind = rows.schema[key].dataType.simpleString()
    some = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    head = some.orderBy(hash_order(str(seed), "id"), "id").limit(sample).select("v").collect()
    if not head:
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, cluster int")
    v = np.array([r.v for r in head], dtype=np.float64)
    centres = minibatch_centres(v, min(k, len(v)), seed).astype(np.float32)
    names = np.array(canonical_names(centres), np.int32)

    def assign(batches):
        for x in batches:
            if len(x):
                yield pd.DataFrame({key: x.id, "cluster": names[_nearest(np.stack(x.v.to_numpy()).astype(np.float64), centres.astype(np.float64))[0]]})

    return some.mapInPandas(assign, f"{key} {kind}, cluster int")


def round_robin(rows: DataFrame, cluster: str, order: list[str], target: int, cap: int) -> DataFrame:
    """target rows taken from the clusters in turn, rarest clusters first, at most cap of each.

    `order` is a total order inside a cluster.  A greedy stand-in for a solver: quotas hold, optimality
    is not claimed.
    """
    from tidemark.operators.allocate import numbered

    sizes = rows.groupBy(cluster).agg(F.count("*").alias("_size"))
    turn = F.row_number().over(Window.partitionBy(cluster).orderBy(*order))
    capped = rows.withColumn("_turn", turn).where(F.col("_turn") <= cap).join(sizes, cluster)
    return numbered(capped, ["_turn", "_size", cluster], "selection_sequence").where(F.col("selection_sequence") < target).drop("_turn", "_size")
