"""Queries of similarity, components, allocation and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import char_trigrams, lower_collapse
from tidemark.operators.allocate import allocate_by_deficit, alternate, greedy_disjoint, greedy_packages, hash_sample, largest_remainder, numbered, quota_sample, shard_numbers
from tidemark.operators.graph import connected_components
from tidemark.operators.setsim import close_pairs
from tidemark.plans.registry import query
from tidemark.plans.staging import forget, merged, spread, stage
from tidemark.sources.tables import table

_TEXT = "trim(regexp_replace(lower(visible_text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_NEAR = f"""n AS (SELECT DISTINCT atom_id, participant_source_id AS p, source_day AS day, session_id, {_TEXT} AS x FROM source_video_atom WHERE visible_text IS NOT NULL),
g AS (SELECT atom_id, p, day, session_id, list_distinct(CASE WHEN length(x) < 3 THEN [x] ELSE list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) END) AS s FROM n WHERE x <> ''),
np AS (SELECT a.atom_id AS key_1, b.atom_id AS key_2, a.session_id AS session_1, b.session_id AS session_2, CAST(len(list_intersect(a.s, b.s)) AS INTEGER) AS n_both, a.s AS sa, b.s AS sb
  FROM g a JOIN g b ON a.p = b.p AND a.day = b.day AND a.atom_id < b.atom_id AND a.session_id <> b.session_id AND len(a.s) * 100 >= len(b.s) * 92 AND len(b.s) * 100 >= len(a.s) * 92),
near AS (SELECT key_1, key_2, session_1, session_2, n_both, CAST(len(sa) + len(sb) - n_both AS INTEGER) AS n_union FROM np WHERE n_both * 100 >= (len(sa) + len(sb) - n_both) * 92)"""


_BLOCK = ["participant_source_id", "source_day"]


def _near(spark, d):
    """(members i, atom_id, session_id, x, r; pairs key_1, key_2, n_both, n_union of different texts r).

    Equal texts of a block are one, r, with its members; what has no session or block is in no pair.
    """
    a = spread(table(spark, d, "source_video_atom")).where("visible_text is not null").select("atom_id", *_BLOCK, "session_id", lower_collapse("visible_text").alias("x")).where("x <> ''").dropDuplicates(["atom_id"])
    a = a.dropna(subset=[*_BLOCK, "session_id"]).withColumn("i", F.monotonically_increasing_id())
    members = stage(a.withColumn("r", F.min("i").over(Window.partitionBy(*_BLOCK, "x"))), "near-texts")
    forget(spark)
    return members, close_pairs(members.where("i = r"), "i", char_trigrams("x"), "0.92", _BLOCK)


def _n_near(near):
    """n_near_pairs: how many pairs of members of different sessions there are, without making them."""
    members, pairs = near
    by_session = stage(members.groupBy("r", "session_id").agg(F.count("*").alias("n")), "near-sessions")
    total = by_session.groupBy("r").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    side = lambda t, x: merged(t.withColumnsRenamed({"r": f"key_{x}", "n": f"n{x}"}))
    near = pairs.select("key_1", "key_2").join(side(total.drop("nn"), 1), "key_1").join(side(total.drop("nn"), 2), "key_2")
    same = pairs.select("key_1", "key_2").join(side(by_session, 1), "key_1").join(side(by_session, 2), ["key_2", "session_id"])
    product = F.col("n1") * F.col("n2")
    parts = [total.select(((F.col("n") * F.col("n") - F.col("nn")) / 2).cast("bigint").alias("n")), near.select(product.alias("n")), same.select((-product).alias("n"))]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_near_pairs"))


@query("near_dup_pairs", f"WITH {_NEAR} SELECT key_1, key_2, n_both, n_union FROM near")
def near_dup_pairs(spark, d):
    """JN4, AG6, PRJ12-13, FLT5: near-duplicate texts of one participant and day in different sessions, exactly."""
    members, pairs = _near(spark, d)
    side = lambda x: members.select(F.col("r").alias(f"key_{x}"), F.col("atom_id").alias(f"a{x}"), F.col("session_id").alias(f"s{x}"))
    near = pairs.join(side(1), "key_1").join(side(2), "key_2").where("s1 <> s2").select("a1", "a2", "n_both", "n_union")
    n = members.where("i = r").select(F.col("r").alias("key_2"), F.size(F.array_distinct(char_trigrams("x"))).alias("n_both"))
    copies = side(1).withColumnRenamed("key_1", "key_2").join(side(2), "key_2").where("a1 < a2 and s1 <> s2").join(n, "key_2").select("a1", "a2", "n_both", F.col("n_both").alias("n_union"))
    return near.union(copies).select(F.least("a1", "a2").alias("key_1"), F.greatest("a1", "a2").alias("key_2"), "n_both", "n_union")


_LINKS = f"""{_NEAR}, a AS (SELECT DISTINCT atom_id, 'g:' || source_group_id AS g, 's:' || session_id AS s, 'w:' || CASE WHEN lower(trim(world_event_id)) NOT IN ('', 'none', 'n/a') THEN trim(world_event_id) END AS w FROM source_video_atom),
e AS (SELECT DISTINCT g AS u, s AS v FROM a WHERE g IS NOT NULL AND s IS NOT NULL UNION SELECT DISTINCT w, s FROM a WHERE w IS NOT NULL AND s IS NOT NULL UNION SELECT DISTINCT 's:' || session_1, 's:' || session_2 FROM near),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e UNION SELECT u, u FROM e UNION SELECT v, v FROM e),
r AS (SELECT u AS node, v AS other FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.other = b.u),
c AS (SELECT node, min(other) AS component FROM r GROUP BY node)"""


def _links(spark, d, near):
    event = F.when(~F.lower(F.trim("world_event_id")).isin("", "none", "n/a"), F.trim("world_event_id"))
    rows = table(spark, d, "source_video_atom")
    a = rows.select(F.concat(F.lit("g:"), "source_group_id").alias("g"), F.concat(F.lit("s:"), "session_id").alias("s"), F.concat(F.lit("w:"), event).alias("w")).distinct()
    named = a.select("s", F.explode(F.array("g", "w")).alias("u")).where("u is not null and s is not null").distinct()
    members, pairs = near
    # All sessions of a text hang at its first one, and the first ones of two near texts together: the same components as of all pairs.
    session = members.select("r", F.concat(F.lit("s:"), "session_id").alias("s")).distinct()
    first = session.groupBy("r").agg(F.min("s").alias("u"))
    copies = session.join(merged(first), "r").select("s", "u")
    close = pairs.join(merged(first.withColumnsRenamed({"r": "key_1", "u": "s"})), "key_1").join(merged(first.withColumnRenamed("r", "key_2")), "key_2").select("s", "u")
    return named.unionByName(copies.union(close).where("s <> u").distinct())


def _components(spark, d, near=None):
    return stage(connected_components(_links(spark, d, near or _near(spark, d)), "u", "s"), "components")


@query("dup_components", f"WITH RECURSIVE {_LINKS} SELECT node, component FROM c")
def dup_components(spark, d):
    """GR1: connected components over groups, sessions, events and near-duplicate texts."""
    return _components(spark, d)


@query("component_links", f"WITH RECURSIVE {_LINKS} SELECT count(*) AS n_nodes, count(DISTINCT component) AS n_components, count(*) - count(DISTINCT component) AS n_links, (SELECT count(*) FROM near) AS n_near_pairs FROM c")
def component_links(spark, d):
    """GR1: how many links joined components, whatever their order: nodes less components."""
    near = _near(spark, d)
    counted = _components(spark, d, near).agg(F.count("*").alias("n_nodes"), F.countDistinct("component").alias("n_components"))
    return counted.withColumn("n_links", F.col("n_nodes") - F.col("n_components")).crossJoin(_n_near(near))


@query(
    "component_ids",
    f"WITH RECURSIVE {_LINKS} SELECT substr(sha256(string_agg(node, '|' ORDER BY node)), 1, 16) AS component_id, count(*) AS n_nodes FROM c GROUP BY component",
)
def component_ids(spark, d):
    """GR2: a stable id of each component from its sorted members; SHA-256 needs them as one text."""
    c = _components(spark, d)
    return c.groupBy("component").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "|"), 256), 1, 16).alias("component_id"), F.count("*").alias("n_nodes")).drop("component")


@query("split_allocation")
def split_allocation(spark, d):
    """GR3-4, AG7: components to splits by deficit, joined back to the groups."""
    c = _components(spark, d)
    a = table(spark, d, "source_video_atom").select("atom_id", F.concat(F.lit("s:"), "session_id").alias("node")).distinct()
    sizes = a.join(c, "node").groupBy("component").agg(F.count("*").alias("n"))
    splits = allocate_by_deficit(sizes, "component", "n", ("train", "dev", "test"), (0.70, 0.15, 0.15), 20260829)
    return c.where(F.col("node").startswith("g:")).join(splits, "component").select(F.substring("node", 3, 1_000_000).alias("source_group_id"), "component", "split")


_STRATA = "SELECT split, participant, coverage, count(*) AS n, min(atom_id) AS least FROM (SELECT DISTINCT atom_id, lower(trim(split)) AS split, participant_source_id AS participant, modality_coverage AS coverage FROM source_video_atom WHERE split IS NOT NULL) GROUP BY 1, 2, 3"


def _strata_rows(spark, d):
    return table(spark, d, "source_video_atom").where("split is not null").select("atom_id", F.lower(F.trim("split")).alias("split"), F.col("participant_source_id").alias("participant"), F.col("modality_coverage").alias("coverage")).dropDuplicates(["atom_id"])


@query(
    "largest_remainder",
    f"""WITH s AS (SELECT *, CAST(least(900, sum(n) OVER ()) AS BIGINT) AS goal FROM ({_STRATA})), t AS (SELECT *, CAST(n * goal // sum(n) OVER () AS BIGINT) AS base, n * goal % sum(n) OVER () AS rest FROM s),
        r AS (SELECT *, goal - sum(base) OVER () AS spare, row_number() OVER (ORDER BY rest DESC, least, split, participant, coverage) AS k FROM t)
        SELECT split, participant, coverage, n, CAST(base + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""",
)
def largest_remainder_quotas(spark, d):
    """GR5: 900 shared out over split, participant and coverage."""
    s = _strata_rows(spark, d).groupBy("split", "participant", "coverage").agg(F.count("*").alias("n"), F.min("atom_id").alias("least"))
    return largest_remainder(s, ["split", "participant", "coverage"], "n", 900, "least").select("split", "participant", "coverage", "n", "quota")


@query(
    "quota_sample",
    """WITH a AS (SELECT DISTINCT atom_id, lower(trim(split)) AS split FROM source_video_atom WHERE split IS NOT NULL), s AS (SELECT split, count(*) AS n FROM a GROUP BY 1),
       t AS (SELECT *, n * 600 // sum(n) OVER () AS base, n * 600 % sum(n) OVER () AS rest FROM s),
       q AS (SELECT split, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, split) <= 600 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM t),
       r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('seed-1' || chr(0) || atom_id), atom_id) AS k FROM a)
       SELECT atom_id, split, CAST(k AS INTEGER) AS sample_rank FROM r JOIN q USING (split) WHERE k <= quota""",
)
def quota_sample_atoms(spark, d):
    """GR6, GR10-11: a proportional sample by quotas, in hash order within each stratum."""
    a = _strata_rows(spark, d).select("atom_id", "split")
    return quota_sample(a, ["split"], "atom_id", "seed-1", 600).select("atom_id", "split", "sample_rank")


@query(
    "hash_sample",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('audit' || chr(0) || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders)
       SELECT o_orderkey, o_orderpriority, CAST(k AS INTEGER) AS sample_rank FROM r WHERE k <= 50""",
)
def hash_sample_orders(spark, d):
    """GR12, SO2: fifty of each stratum in the order of a seeded hash."""
    return hash_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", "audit", 50)


@query(
    "sample_shortfall",
    "SELECT o_orderpriority, o_orderstatus, least(count(*), 400) AS n_sampled, greatest(400 - count(*), 0) AS shortfall FROM orders GROUP BY 1, 2",
)
def sample_shortfall(spark, d):
    """GR12, AG11: how many a stratum lacks of what was asked."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    n = hash_sample(rows, ["o_orderpriority", "o_orderstatus"], "o_orderkey", "audit", 400).groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n_sampled"))
    return n.withColumn("shortfall", 400 - F.col("n_sampled"))


_POSITION = "p AS (SELECT atom_id, row_number() OVER (ORDER BY atom_id) - 1 AS position FROM (SELECT DISTINCT atom_id FROM source_video_atom))"


@query("alternating_parts", f"WITH {_POSITION} SELECT atom_id, CAST(position % 2 AS INTEGER) AS way FROM p")
def alternating_parts(spark, d):
    """GR8: rows dealt out in turn to two parts, without a window over all rows."""
    return alternate(table(spark, d, "source_video_atom").select("atom_id").distinct(), ["atom_id"])


@query(
    "shard_numbers",
    f"""WITH {_POSITION}, s AS (SELECT atom_id, position, position // 500 AS shard, position // 500 // 10 AS task FROM p)
        SELECT *, CASE WHEN task < 1 THEN 0 WHEN task < 61 THEN 1 + (task - 1) // 10 ELSE 7 END AS wave FROM s""",
)
def shard_numbers_atoms(spark, d):
    """GR14, SRC12: shard, task and wave of each row's position."""
    p = numbered(table(spark, d, "source_video_atom").select("atom_id").distinct(), ["atom_id"])
    shard, task, wave = shard_numbers(F.col("position"))
    return p.select("atom_id", "position", shard.alias("shard"), task.alias("task"), wave.alias("wave"))


@query(
    "greedy_packages",
    """WITH RECURSIVE b AS (SELECT atom_id, CAST(strlen(coalesce(visible_text, '')) AS INTEGER) AS size, position, position // 500 AS shard FROM (SELECT atom_id, visible_text, row_number() OVER (ORDER BY atom_id) - 1 AS position FROM (SELECT DISTINCT atom_id, visible_text FROM source_video_atom))),
       f AS (SELECT atom_id, size, position, shard, 0 AS package, 1 AS items, size AS total FROM b WHERE position % 500 = 0
         UNION ALL SELECT b.atom_id, b.size, b.position, b.shard, f.package + CASE WHEN f.items >= 5 OR f.total + b.size > 1500 THEN 1 ELSE 0 END, CASE WHEN f.items >= 5 OR f.total + b.size > 1500 THEN 1 ELSE f.items + 1 END,
           CASE WHEN f.items >= 5 OR f.total + b.size > 1500 THEN b.size ELSE f.total + b.size END FROM f JOIN b ON b.position = f.position + 1 AND b.shard = f.shard)
       SELECT atom_id, shard, package, size, size > 1500 AS oversize FROM f""",
)
def greedy_packages_atoms(spark, d):
    """GR13: packages of at most five items and 1,500 bytes, in the order of ids inside shards of 500."""
    a = table(spark, d, "source_video_atom").select("atom_id", F.octet_length(F.coalesce("visible_text", F.lit(""))).alias("size")).dropDuplicates(["atom_id"])
    p = numbered(a, ["atom_id"])
    return greedy_packages(p.withColumn("shard", F.floor(F.col("position") / 500)), "shard", "position", "size", 5, 1_500).select("atom_id", "shard", "package", "size", "oversize")


@query(
    "greedy_disjoint",
    """WITH RECURSIVE r AS MATERIALIZED (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, parts FROM orders JOIN (SELECT l_orderkey, list_distinct(list(l_partkey)) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
       f AS (SELECT k, o_orderkey, true AS taken, parts AS used FROM r WHERE k = 1
         UNION ALL SELECT k, o_orderkey, taken, CASE WHEN taken THEN list_concat(used, parts) ELSE used END FROM (SELECT r.k, r.o_orderkey, r.parts, f.used, NOT list_has_any(f.used, r.parts) AS taken FROM f JOIN r ON r.k = f.k + 1))
       SELECT o_orderkey FROM f WHERE taken""",
)
def greedy_disjoint_orders(spark, d):
    """SO4: orders accepted by date, skipping each that uses a part that an accepted one has used."""
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    rows = table(spark, d, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "parts")
    return greedy_disjoint(rows, "o_orderkey", ["o_orderdate"], "parts")


@query(
    "calibration_index",
    """WITH q AS (SELECT dimension, value_id, dense_rank() OVER (ORDER BY dimension) - 1 AS pos, row_number() OVER (PARTITION BY dimension ORDER BY value_id) - 1 AS idx FROM cue_value_ref)
       SELECT dimension, value_id, CAST(pos * 50 + idx AS BIGINT) AS global_index, idx < 50 AS inside FROM q""",
)
def calibration_index(spark, d):
    """GR7: a global index from the place of the stratum and the place in it, with a range check."""
    from pyspark.sql import Window

    r = table(spark, d, "cue_value_ref").select("dimension", "value_id")
    places = numbered(r.select("dimension").distinct(), ["dimension"], "pos")
    idx = F.row_number().over(Window.partitionBy("dimension").orderBy("value_id")) - 1
    return r.withColumn("idx", idx).join(places, "dimension").select("dimension", "value_id", (F.col("pos") * 50 + F.col("idx")).alias("global_index"), (F.col("idx") < 50).alias("inside"))


@query(
    "retrieval_channel",
    """WITH m AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
       SELECT o_custkey, CASE WHEN f AND o THEN 'both' WHEN f THEN 'first' WHEN o THEN 'second' ELSE 'neither' END AS channel FROM m""",
)
def retrieval_channel(spark, d):
    """GR9: a class from the set of memberships, by precedence."""
    m = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("in"))
    f, o = F.array_contains("in", "F"), F.array_contains("in", "O")
    return m.select("o_custkey", F.when(f & o, "both").when(f, "first").when(o, "second").otherwise("neither").alias("channel"))
