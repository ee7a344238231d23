"""Queries of retrieval and selection over the embeddings: every fiftieth row asks, all rows answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import retrieve as R
from tidemark.plans.registry import query
from tidemark.sources.tables import table

K = 64
NEAR = 0.7

_DENSE = f"""d AS (SELECT query_id, vec_id, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= {K})"""
_SPARSE = f"""w AS (SELECT vec_id, i, abs(x) AS x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE abs(x) > 0.15),
sp AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x) AS score FROM w a JOIN w b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
s AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY coalesce(sp.score, 0) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id LEFT JOIN sp ON sp.query_id = q.vec_id AND sp.vec_id = c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= {K})"""
_FUSED = f"""{_DENSE}, {_SPARSE}, f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.vec_id, s.vec_id) AS vec_id, d.rank AS rank_dense, s.rank AS rank_sparse,
  coalesce(1 / (60 + d.rank), 0) + coalesce(1 / (60 + s.rank), 0) AS score FROM d FULL JOIN s ON d.query_id = s.query_id AND d.vec_id = s.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 14) DESC, vec_id) AS rank FROM f)"""


def _e(spark, d):
    e = table(spark, d, "embeddings")
    big = F.map_filter(F.map_from_entries(F.transform("embedding", lambda x, i: F.struct(i, F.abs(x.cast("double"))))), lambda _, x: x > 0.15)
    return e.withColumn("weights", big)


def _lists(spark, d):
    e = _e(spark, d)
    q = e.where("vec_id % 50 = 0")
    return e, R.dense_topk(q, e, "vec_id", "embedding", K), R.sparse_topk(q, e, "vec_id", "weights", K)


def _fused(spark, d):
    e, a, b = _lists(spark, d)
    return e, R.fused(a, b, "vec_id")


@query("dense_topk", f"WITH {_DENSE} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM d")
def dense_topk(spark, d):
    """RT1, JN6, PRJ19: exact nearest rows by inner product."""
    return _lists(spark, d)[1].select("query_id", "vec_id", "rank")


@query("sparse_topk", f"WITH {_SPARSE} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM s")
def sparse_topk(spark, d):
    """RT2: nearest rows by sparse weights, rows of score zero included."""
    return _lists(spark, d)[2].select("query_id", "vec_id", "rank")


@query("rrf_fusion", f"WITH {_FUSED} SELECT query_id, vec_id, CAST(rank_dense AS INTEGER) AS rank_dense, CAST(rank_sparse AS INTEGER) AS rank_sparse, round(score, 12) AS rrf_score, CAST(rank AS INTEGER) AS rank FROM r")
def rrf_fusion(spark, d):
    """RT3, JN7: reciprocal-rank fusion of both lists."""
    _, f = _fused(spark, d)
    return f.select("query_id", "vec_id", F.col("rank_a").alias("rank_dense"), F.col("rank_b").alias("rank_sparse"), F.round("rrf_score", 12).alias("rrf_score"), "rank")


_PICK = f"""WITH {_FUSED}, c AS (SELECT r.query_id, r.vec_id, r.rank, q.label = e.label AS same FROM r JOIN embeddings e USING (vec_id) JOIN embeddings q ON q.vec_id = r.query_id WHERE e.embedding[1] < 0.1),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, same ORDER BY rank) AS n, count(DISTINCT same) OVER (PARTITION BY query_id) AS kinds FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n = 1 AND same THEN 0 WHEN n = 1 THEN 1 ELSE 2 END, rank) AS pick FROM t WHERE kinds = 2)
SELECT query_id, vec_id, CAST(pick AS INTEGER) AS pick, same FROM p WHERE pick <= 4"""


@query("lure_pick", _PICK)
def lure_pick(spark, d):
    """RT4-5: per query the best failing row of its own group, the best of another, then by rank, four in all."""
    e, f = _fused(spark, d)
    info = e.select("vec_id", "label", (F.element_at("embedding", 1) < 0.1).alias("fails"))
    rows = f.join(info, "vec_id").join(info.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id").where("fails").withColumn("same", F.col("label") == F.col("q_label"))
    return R.constrained_pick(rows, "query_id", "rank", F.col("same"), 4).select("query_id", "vec_id", "pick", "same")


@query(
    "retrieval_gate",
    _PICK.replace("SELECT query_id, vec_id, CAST(pick AS INTEGER) AS pick, same FROM p WHERE pick <= 4", """, q4 AS (SELECT query_id, count(*) AS n_picks, count(*) FILTER (same) AS n_same, bool_or(query_id = vec_id) AS picks_itself, bool_or(pick = 1 AND NOT same) OR bool_or(pick = 2 AND same) AS wrong_head FROM p WHERE pick <= 4 GROUP BY 1)
SELECT e.vec_id AS query_id, CASE WHEN n_picks IS NULL THEN 'no_picks' WHEN n_picks < 4 THEN 'too_few' WHEN picks_itself THEN 'itself' WHEN n_same = 0 OR n_same = n_picks THEN 'one_group' WHEN wrong_head THEN 'order' ELSE 'ok' END AS code
FROM embeddings e LEFT JOIN q4 ON q4.query_id = e.vec_id WHERE e.vec_id % 50 = 0"""),
)
def retrieval_gate(spark, d):
    """RT5: the rule that the picks of each query break: four of them, not the query itself, both groups, the best of each first."""
    p = lure_pick(spark, d).groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if("same").alias("n_same"), F.bool_or(F.col("query_id") == F.col("vec_id")).alias("itself"), (F.bool_or((F.col("pick") == 1) & ~F.col("same")) | F.bool_or((F.col("pick") == 2) & F.col("same"))).alias("wrong")
    )
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    code = F.when(F.col("n").isNull(), "no_picks").when(F.col("n") < 4, "too_few").when(F.col("itself"), "itself").when((F.col("n_same") == 0) | (F.col("n_same") == F.col("n")), "one_group").when(F.col("wrong"), "order").otherwise("ok")
    return asked.join(p, "query_id", "left").select("query_id", code.alias("code"))


@query(
    "primary_query",
    f"""WITH {_FUSED}, x AS (SELECT r.vec_id, query_id, round(score, 12) AS rrf_score, row_number() OVER (PARTITION BY r.vec_id ORDER BY coalesce(1000000000000000000000000::HUGEINT // (60 + rank_dense), 0) + coalesce(1000000000000000000000000::HUGEINT // (60 + rank_sparse), 0) DESC,
        least(coalesce(rank_dense, 9999), coalesce(rank_sparse, 9999)), q.label, query_id) AS n, count(*) OVER (PARTITION BY r.vec_id) AS n_queries FROM r JOIN embeddings q ON q.vec_id = r.query_id)
        SELECT vec_id, query_id, rrf_score, n_queries FROM x WHERE n = 1""",
)
def primary_query(spark, d):
    """RT6: the query to which each retrieved row is attributed: fusion score, compared exactly, best rank, family, id."""
    from pyspark.sql import Window

    e, f = _fused(spark, d)
    f = f.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    best = F.least(F.coalesce("rank_a", F.lit(9999)), F.coalesce("rank_b", F.lit(9999)))
    n = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("rrf_exact"), best, "label", "query_id"))
    return f.withColumn("n", n).withColumn("n_queries", F.count("*").over(Window.partitionBy("vec_id"))).where("n = 1").select("vec_id", "query_id", F.round("rrf_score", 12).alias("rrf_score"), "n_queries")


@query(
    "channel_metrics",
    f"""WITH {_FUSED} SELECT q.label, count(rank_dense) AS n_dense, count(rank_sparse) AS n_sparse, count(*) FILTER (rank_dense IS NOT NULL AND rank_sparse IS NOT NULL) AS n_both, count(DISTINCT r.vec_id) AS n_rows
        FROM r JOIN embeddings q ON q.vec_id = r.query_id GROUP BY 1""",
)
def channel_metrics(spark, d):
    """AG11: what each channel retrieved, by family of the query."""
    e, f = _fused(spark, d)
    q = e.select(F.col("vec_id").alias("query_id"), "label")
    both = F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()
    return f.join(q, "query_id").groupBy("label").agg(F.count("rank_a").alias("n_dense"), F.count("rank_b").alias("n_sparse"), F.count_if(both).alias("n_both"), F.countDistinct("vec_id").alias("n_rows"))


_NEAR = f"""n AS (SELECT a.label, a.vec_id AS id_1, b.vec_id AS id_2 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE CAST(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS FLOAT) <= CAST({NEAR} AS FLOAT))"""


@query("near_in_cluster", f"WITH {_NEAR} SELECT label, id_1, id_2 FROM n")
def near_in_cluster(spark, d):
    """PRJ20: pairs of a cluster within a cosine distance, exactly, block by block."""
    return R.near_in_cluster(table(spark, d, "embeddings"), "vec_id", "label", "embedding", NEAR).select("label", "id_1", "id_2")


_KEPT = f"""{_NEAR}, o AS (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) AS k, (SELECT list(id_1) FROM n WHERE n.id_2 = e.vec_id) AS earlier FROM embeddings e),
f AS (SELECT label, k, vec_id, [vec_id] AS kept, true AS survives FROM o WHERE k = 1
  UNION ALL SELECT o.label, o.k, o.vec_id, CASE WHEN coalesce(list_has_any(f.kept, o.earlier), false) THEN f.kept ELSE list_append(f.kept, o.vec_id) END, NOT coalesce(list_has_any(f.kept, o.earlier), false) FROM f JOIN o ON o.label = f.label AND o.k = f.k + 1)"""


@query("survivors", f"WITH RECURSIVE {_KEPT} SELECT vec_id, survives FROM f")
def survivors(spark, d):
    """RT10: rows that no earlier survivor of their cluster is near."""
    e = table(spark, d, "embeddings")
    return R.survivors(e, "vec_id", ["vec_id"], R.near_in_cluster(e, "vec_id", "label", "embedding", NEAR))


@query(
    "reservoirs",
    """WITH RECURSIVE m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS centre FROM m GROUP BY 1),
       d AS MATERIALIZED (SELECT a.label, a.vec_id AS a, b.vec_id AS b, 1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS far FROM embeddings a JOIN embeddings b ON a.label = b.label),
       s AS (SELECT label, vec_id FROM (SELECT e.label, vec_id, row_number() OVER (PARTITION BY e.label ORDER BY 1 - list_inner_product(embedding::DOUBLE[], centre), vec_id) AS k FROM embeddings e JOIN c USING (label)) WHERE k = 1),
       f AS (SELECT label, vec_id, 1 AS place, [vec_id] AS chosen FROM s
         UNION ALL SELECT label, vec_id, place, list_append(chosen, vec_id) FROM (SELECT f.label, d.b AS vec_id, f.place + 1 AS place, f.chosen, row_number() OVER (PARTITION BY f.label ORDER BY min(d.far) DESC, d.b) AS k
           FROM f JOIN d ON d.label = f.label AND list_contains(f.chosen, d.a) AND NOT list_contains(f.chosen, d.b) WHERE f.place < 16 GROUP BY f.label, d.b, f.place, f.chosen) WHERE k = 1)
       SELECT label, vec_id, CAST(place AS INTEGER) AS place FROM f""",
)
def reservoirs(spark, d):
    """RT11: a diverse reservoir of each cluster."""
    return R.reservoirs(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 16)


@query("survivor_rescan", f"WITH {_NEAR} SELECT label, count(*) AS n_pairs, count(DISTINCT id_1) AS n_first FROM n GROUP BY 1")
def survivor_rescan(spark, d):
    """The near pairs of all rows of each cluster, counted."""
    return R.near_in_cluster(table(spark, d, "embeddings"), "vec_id", "label", "embedding", NEAR).groupBy("label").agg(F.count("*").alias("n_pairs"), F.countDistinct("id_1").alias("n_first"))


@query(
    "survivor_spacing",
    f"""WITH RECURSIVE {_KEPT}, s AS (SELECT e.* FROM f JOIN embeddings e USING (vec_id) WHERE f.survives), p AS (SELECT a.label, min(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS least FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
        SELECT label, count(*) AS n_survivors, round(max(least), 5) AS min_distance FROM s LEFT JOIN p USING (label) GROUP BY 1""",
)
def survivor_spacing(spark, d):
    """RT15: the survivors read again with their vectors: number and smallest distance in each cluster, above NEAR."""
    e = table(spark, d, "embeddings")
    return R.survivor_spacing(e, "vec_id", "label", "embedding", survivors(spark, d)).withColumn("min_distance", F.round(F.col("min_distance").cast("double"), 5))


@query("projection")
def projection(spark, d):
    """RT7: sparse random projection to 16 dimensions."""
    return R.projected(table(spark, d, "embeddings"), "embedding", 16)


@query("minibatch_clusters")
def minibatch_clusters(spark, d):
    """RT8-9: mini-batch k-means over the projected vectors, fitted on a bounded sample, assigned to all."""
    return R.minibatch_clustered(R.projected(table(spark, d, "embeddings"), "embedding", 16), "vec_id", "embedding", 10)


@query("clusters")
def clusters(spark, d):
    """RT9: k-means with canonical cluster ids."""
    return R.clustered(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


@query(
    "round_robin",
    """WITH t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn, count(*) OVER (PARTITION BY label) AS size FROM embeddings),
       s AS (SELECT vec_id, label, row_number() OVER (ORDER BY turn, size, label) - 1 AS selection_sequence FROM t WHERE turn <= 12) SELECT * FROM s WHERE selection_sequence < 100""",
)
def round_robin(spark, d):
    """RT12-13: a hundred rows from the clusters in turn, twelve of each at most."""
    return R.round_robin(table(spark, d, "embeddings").select("vec_id", "label"), "label", ["vec_id"], 100, 12).select("vec_id", "label", "selection_sequence")
