"""Queries of artifacts and packages: written and read back, sharded, sampled by plan, packed and summed up."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.allocate import floor_quotas, hash_order, largest_remainder, numbered, ranked_by_hash
from tidemark.operators.automaton import REMINDER
from tidemark.plans.allocation_queries import greedy_packages_atoms
from tidemark.plans.registry import query
from tidemark.plans.staging import shared_dir, stage
from tidemark.sources import artifacts, subtitles
from tidemark.sources.tables import table


def _aside(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("json_lines_round_trip", "SELECT segment_id, srt_block_index, start_sec, text, false AS corrupt FROM (SELECT DISTINCT segment_id, srt_block_index, start_sec, text FROM segments) UNION ALL SELECT NULL, NULL, NULL, NULL, true")
def json_lines_round_trip(spark, d):
    """SRC5, SRC7: rows as line-JSON and back, with a blank line, which is skipped, and a broken one, which comes as a row."""
    s = table(spark, d, "segments").select("segment_id", "srt_block_index", "start_sec", "text").distinct()
    where = _aside(spark, "json")
    s.select(F.to_json(F.struct("*"))).unionAll(spark.createDataFrame([("",), ('{"segment_id": "cut',)], "value string")).write.text(where)
    back = artifacts.read_json_lines(spark, where, "segment_id string, srt_block_index int, start_sec double, text string")
    return stage(back, "json-back").withColumn("corrupt", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


@query("csv_round_trip", "SELECT DISTINCT segment_id, srt_block_index, start_sec, parse_status FROM segments")
def csv_round_trip(spark, d):
    """SRC4, SRC6: a table published as CSV with a header and a marker, and read back through the marker."""
    s = table(spark, d, "segments").select("segment_id", "srt_block_index", "start_sec", "parse_status").distinct()
    where = _aside(spark, "csv")
    artifacts.publish(s, where, kind="csv")
    return artifacts.open_verified(spark, where, s.schema)


@query(
    "published_gate",
    """SELECT * FROM (VALUES ('as published', 'ok'), ('other version', 'refused'), ('other upstream', 'refused'), ('row more', 'refused'), ('no marker', 'refused')) t(what, outcome)""",
)
def published_gate(spark, d):
    """SRC8-9, VL13-14, DM14: an artifact opens only as it was published: version, upstream hashes, rows, content."""
    s = table(spark, d, "cue_value_ref")
    where = _aside(spark, "gate")
    artifacts.publish(s, where, artifacts.Publication("2", {"cues": "abc"}))
    touched = _aside(spark, "gate")
    artifacts.publish(s, touched, artifacts.Publication("2"))
    s.limit(1).write.mode("append").parquet(touched)
    bare = _aside(spark, "gate")
    s.write.parquet(bare)
    tries = {"as published": (where, "2", {"cues": "abc"}), "other version": (where, "3", {}), "other upstream": (where, "2", {"cues": "xyz"}), "row more": (touched, "2", {}), "no marker": (bare, "2", {})}
    out = []
    for what, (path, version, upstream) in tries.items():
        try:
            artifacts.open_verified(spark, path, s.schema, version, upstream)
            out.append((what, "ok"))
        except artifacts.GateError:
            out.append((what, "refused"))
    return spark.createDataFrame(out, "what string, outcome string")


_SHARDED = """p AS (SELECT atom_id, row_number() OVER (ORDER BY atom_id) - 1 AS position FROM (SELECT DISTINCT atom_id FROM source_video_atom)), s AS (SELECT atom_id, position, CAST(position // 500 AS INTEGER) AS shard FROM p)"""


def _sharded(spark, d):
    p = numbered(table(spark, d, "source_video_atom").select("atom_id").distinct(), ["atom_id"])
    return p.select("atom_id", "position", F.floor(F.col("position") / 500).cast("int").alias("shard"))


@query(
    "shard_manifest",
    f"""WITH {_SHARDED}, h AS (SELECT shard, count(*) AS n_rows, min(atom_id) AS first_id, max(atom_id) AS last_id FROM s GROUP BY 1)
        SELECT shard, n_rows, CASE WHEN shard = 0 THEN n_rows + 1 WHEN shard = 1 THEN n_rows ELSE n_rows END AS expected_rows, CASE WHEN shard = 0 THEN 'row_count' WHEN shard = 1 THEN 'content' ELSE 'ok' END AS status FROM h
        UNION ALL SELECT max(shard) + 1, NULL, 7, 'missing_shard' FROM h""",
)
def shard_manifest(spark, d):
    """SRC10, RT14, LG5, VL24: a table of shards against its manifest of rows and content hashes, with three faults planted."""
    where = _aside(spark, "shards")
    _sharded(spark, d).write.partitionBy("shard").parquet(where)
    rows = spark.read.schema("atom_id string, position bigint, shard int").parquet(where)
    made = stage(artifacts.shard_hashes(rows, "shard"), "manifest")
    last = made.agg(F.max("shard") + 1).first()[0] or 0
    off = made.withColumn("n_rows", F.when(F.col("shard") == 0, F.col("n_rows") + 1).otherwise(F.col("n_rows"))).withColumn("hash", F.when(F.col("shard") == 1, F.lit("0")).otherwise(F.col("hash")))
    planted = off.unionByName(spark.createDataFrame([(last, 7, "0")], "shard int, n_rows bigint, hash string"))
    return artifacts.manifest_check(rows, planted, "shard").select("shard", "n_rows", "expected_rows", "status")


@query("wave_scan", f"WITH {_SHARDED} SELECT atom_id, position, shard FROM s WHERE shard IN (1, 3)")
def wave_scan(spark, d):
    """SRC12, LG12: the shards of one wave only; the others' files are not opened (partition pruning)."""
    where = _aside(spark, "waves")
    _sharded(spark, d).write.partitionBy("shard").parquet(where)
    return spark.read.schema("atom_id string, position bigint, shard int").parquet(where).where(F.col("shard").isin(1, 3))


@query("candidate_head", "SELECT DISTINCT atom_id, session_id FROM source_video_atom ORDER BY atom_id LIMIT 100")
def candidate_head(spark, d):
    """SO1, SO3: the first hundred candidates in the order of their ids; each partition keeps a hundred before the merge."""
    return table(spark, d, "source_video_atom").select("atom_id", "session_id").distinct().orderBy("atom_id").limit(100)


_CASE = "CASE WHEN parse_status = 'error' THEN error WHEN parse_status = 'discarded_empty' THEN 'empty' WHEN coalesce(trim(text), '') = '' THEN 'empty' ELSE 'plain' END"


@query(
    "parse_errors",
    f"""WITH s AS (SELECT DISTINCT segment_id, {_CASE} AS kind FROM segments)
        SELECT segment_id, CASE kind WHEN 'empty' THEN 'discarded_empty' WHEN 'plain' THEN 'ok' ELSE 'error' END AS parse_status,
          CASE kind WHEN 'empty' THEN 'empty_text' WHEN 'plain' THEN NULL WHEN 'non_positive_duration' THEN kind ELSE 'missing_or_invalid_timecode' END AS error FROM s""",
)
def parse_errors(spark, d):
    """PRJ3: a subtitle file for each block, broken in the way that the block's status names, and parsed again."""
    kind = F.when(F.col("parse_status") == "error", F.col("error")).when(F.col("parse_status") == "discarded_empty", "empty").when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").otherwise("plain")
    s = table(spark, d, "segments").select("segment_id", kind.alias("kind")).distinct()
    time = F.when(F.col("kind") == "non_positive_duration", "00:00:05,000 --> 00:00:05,000").when(F.col("kind") == "invalid_timecode", "00:0x:05,000 -> 5").when(F.col("kind") == "missing_or_invalid_timecode", "no time").otherwise("00:00:05,000 --> 00:00:06,500")
    files = s.withColumn("content", F.concat(F.lit("1\r\n"), time, F.lit("\r\n"), F.when(F.col("kind") == "empty", "").otherwise("some words\r\n")))
    return subtitles.parse(files, ["segment_id"], file_key="segment_id").select("segment_id", "parse_status", "error")


_STRATA5 = "split, participant, coverage, day, kind"
_PLAN_ROWS = "(SELECT DISTINCT atom_id, coalesce(lower(trim(split)), 'draft') AS split, participant_source_id AS participant, modality_coverage AS coverage, source_day AS day, atom_kind AS kind FROM source_video_atom)"


def _plan_rows(spark, d):
    a = table(spark, d, "source_video_atom")
    return a.select("atom_id", F.coalesce(F.lower(F.trim("split")), F.lit("draft")).alias("split"), F.col("participant_source_id").alias("participant"), F.col("modality_coverage").alias("coverage"), F.col("source_day").alias("day"), F.col("atom_kind").alias("kind")).distinct()


@query(
    "floor_sample",
    f"""WITH a AS {_PLAN_ROWS}, s AS (SELECT split, participant, coverage, count(*) AS n, least(count(*), 4) AS least_n FROM a GROUP BY 1, 2, 3), u AS (SELECT *, n - least_n AS more, 700 - sum(least_n) OVER () AS left_over, sum(n - least_n) OVER () AS all_more FROM s),
        t AS (SELECT *, more * least(left_over, all_more) // all_more AS base, more * least(left_over, all_more) % all_more AS rest FROM u),
        q AS (SELECT *, least_n + base + CASE WHEN row_number() OVER (ORDER BY rest DESC, split, participant, coverage) <= least(left_over, all_more) - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY split, participant, coverage ORDER BY sha256('20260829' || chr(0) || atom_id), atom_id) AS k FROM a)
        SELECT atom_id, split, participant, coverage FROM r JOIN q USING (split, participant, coverage) WHERE k <= quota""",
)
def floor_sample(spark, d):
    """GR10: at least four of each stratum, the rest by largest remainders, in hash order within the stratum."""
    keys = ["split", "participant", "coverage"]
    a = _plan_rows(spark, d).select("atom_id", *keys)
    quotas = floor_quotas(a.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n", 700, 4)
    return ranked_by_hash(a, keys, "atom_id", "20260829", quotas).select("atom_id", *keys)


@query(
    "bounded_quotas",
    f"""WITH a AS {_PLAN_ROWS}, b AS (SELECT * FROM (VALUES ('train', 300), ('dev', 102), ('test', 198)) t(split, goal)), s AS (SELECT split, participant, count(*) AS n FROM a JOIN b USING (split) GROUP BY 1, 2),
        t AS (SELECT s.*, least(goal, sum(n) OVER w) AS goal, sum(n) OVER w AS total FROM s JOIN b USING (split) WINDOW w AS (PARTITION BY split)), u AS (SELECT *, n * goal // total AS base, n * goal % total AS rest FROM t),
        q AS (SELECT *, base + CASE WHEN row_number() OVER (PARTITION BY split ORDER BY rest DESC, participant) <= goal - sum(base) OVER (PARTITION BY split) THEN 1 ELSE 0 END AS quota FROM u),
        m AS (SELECT split, count(*) FILTER (coverage = 'both') AS n_both, count(*) AS n FROM a GROUP BY 1)
        SELECT split, participant, CAST(quota AS BIGINT) AS quota, CAST(floor(goal * n_both / m.n) AS BIGINT) AS both_at_least, CAST(ceil(goal * n_both / m.n) AS BIGINT) AS both_at_most FROM q JOIN m USING (split)""",
)
def bounded_quotas(spark, d):
    """GR11: goals for each split shared out over participants by largest remainders, and bounds of a modality by floor and ceiling."""
    goals = {"train": 300, "dev": 102, "test": 198}
    a = _plan_rows(spark, d).where(F.col("split").isin(*goals))
    s = a.groupBy("split", "participant").agg(F.count("*").alias("n"))
    m = a.groupBy("split").agg(F.count_if(F.col("coverage") == "both").alias("n_both"), F.count("*").alias("all"))
    goal = F.coalesce(*(F.when(F.col("split") == k, F.lit(v)) for k, v in goals.items()))
    q = None
    for name, size in goals.items():
        part = largest_remainder(s.where(F.col("split") == name), ["participant"], "n", size)
        q = part if q is None else q.unionByName(part)
    share = F.least(goal, F.col("all")) * F.col("n_both") / F.col("all")
    return q.join(m, "split").select("split", "participant", F.col("quota").cast("bigint").alias("quota"), F.floor(share).alias("both_at_least"), F.ceil(share).alias("both_at_most"))


@query(
    "acceptance_plan",
    f"""WITH a AS {_PLAN_ROWS}, s AS (SELECT {_STRATA5}, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT *, n * 240 // sum(n) OVER () AS base, n * 240 % sum(n) OVER () AS rest FROM s),
        q AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, {_STRATA5}) <= 240 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY {_STRATA5} ORDER BY sha256('accept' || chr(0) || atom_id), atom_id) AS k FROM a),
        x AS (SELECT atom_id, split FROM r JOIN q USING ({_STRATA5}) WHERE k <= quota), y AS (SELECT *, row_number() OVER (ORDER BY sha256('overlap' || chr(0) || atom_id), atom_id) AS o FROM x),
        z AS (SELECT *, row_number() OVER (ORDER BY atom_id) AS p FROM y WHERE o > 40) SELECT atom_id, split, 'both' AS reader FROM y WHERE o <= 40 UNION ALL SELECT atom_id, split, CASE p % 2 WHEN 1 THEN 'first' ELSE 'second' END FROM z""",
)
def acceptance_plan(spark, d):
    """GR6, GR8: 240 rows by five-key strata, of which forty go to both readers and the rest in turn to one of two."""
    keys = ["split", "participant", "coverage", "day", "kind"]
    a = _plan_rows(spark, d)
    quotas = largest_remainder(a.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n", 240)
    x = stage(ranked_by_hash(a, keys, "atom_id", "accept", quotas).select("atom_id", "split"), "accepted")
    both = x.orderBy(hash_order("overlap", "atom_id"), "atom_id").limit(40)
    rest = numbered(x.join(both, "atom_id", "left_anti"), ["atom_id"])
    return both.withColumn("reader", F.lit("both")).unionByName(rest.select("atom_id", "split", F.when(F.col("position") % 2 == 0, "first").otherwise("second").alias("reader")))


_PACK = """b AS (SELECT atom_id, CAST(strlen(coalesce(visible_text, '')) AS INTEGER) AS size, position, position // 500 AS shard FROM (SELECT atom_id, visible_text, row_number() OVER (ORDER BY atom_id) - 1 AS position FROM (SELECT DISTINCT atom_id, visible_text FROM source_video_atom))),
f AS (SELECT atom_id, size, position, shard, 0 AS package, 1 AS items, size AS total FROM b WHERE position % 500 = 0
  UNION ALL SELECT b.atom_id, b.size, b.position, b.shard, f.package + CASE WHEN f.items >= 5 OR f.total + b.size > 1500 THEN 1 ELSE 0 END, CASE WHEN f.items >= 5 OR f.total + b.size > 1500 THEN 1 ELSE f.items + 1 END,
    CASE WHEN f.items >= 5 OR f.total + b.size > 1500 THEN b.size ELSE f.total + b.size END FROM f JOIN b ON b.position = f.position + 1 AND b.shard = f.shard)"""


@query(
    "package_manifests",
    f"""WITH RECURSIVE {_PACK} SELECT CAST(shard AS BIGINT) AS shard, package, count(*) AS n_items, sum(size) AS bytes, 'pkg_' || lpad(CAST(shard AS VARCHAR), 5, '0') || '_' || lpad(CAST(package AS VARCHAR), 4, '0') || '_' || substr(sha256(string_agg(atom_id, '|' ORDER BY atom_id)), 1, 12) AS package_id FROM f GROUP BY shard, package""",
)
def package_manifests(spark, d):
    """LG1, DM3: the identity of each package from its place and the hash of its members, at most five."""
    p = greedy_packages_atoms(spark, d).groupBy("shard", "package").agg(F.count("*").alias("n_items"), F.sum("size").alias("bytes"), F.array_sort(F.collect_list("atom_id")).alias("ids"))
    name = F.concat_ws("_", F.lit("pkg"), F.lpad(F.col("shard").cast("string"), 5, "0"), F.lpad(F.col("package").cast("string"), 4, "0"), F.substring(F.sha2(F.array_join("ids", "|"), 256), 1, 12))
    return p.select("shard", "package", "n_items", "bytes", name.alias("package_id"))


_PROGRESS = f"""WITH {_SHARDED}, c AS (SELECT atom_id, min(disposition) AS outcome FROM cue_v2 GROUP BY 1) SELECT shard, count(*) AS total, count(outcome) AS completed, count(*) FILTER (outcome = 'accepted_cue') AS accepted,
  count(*) FILTER (outcome IS NOT NULL AND outcome <> 'accepted_cue') AS not_accepted, count(*) FILTER (outcome = 'accepted_cue') + count(*) FILTER (outcome IS NOT NULL AND outcome <> 'accepted_cue') = count(outcome) AND count(outcome) <= count(*) AS consistent,
  round(count(outcome) / count(*), 6) AS share FROM s LEFT JOIN c USING (atom_id) GROUP BY 1"""


@query("progress_snapshot", _PROGRESS)
def progress_snapshot(spark, d):
    """LG6, VL18: what is done in each shard, with the check that outcomes add up and do not exceed the total."""
    c = table(spark, d, "cue_v2").groupBy("atom_id").agg(F.min("disposition").alias("outcome"))
    j = _sharded(spark, d).join(c, "atom_id", "left")
    good = F.col("outcome") == "accepted_cue"
    per = j.groupBy("shard").agg(F.count("*").alias("total"), F.count("outcome").alias("completed"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("not_accepted"))
    checked = (F.col("accepted") + F.col("not_accepted") == F.col("completed")) & (F.col("completed") <= F.col("total"))
    return per.withColumn("consistent", checked).withColumn("share", F.round(F.col("completed") / F.col("total"), 6))


@query(
    "query_texts",
    """WITH k AS (SELECT DISTINCT cue_id, predicate FROM cue_v2 WHERE predicate IS NOT NULL), u AS (SELECT cue_id, unnest(predicate.all_of) AS c FROM k),
       e AS (SELECT cue_id, string_agg(DISTINCT c.value, '; ' ORDER BY c.value) AS entities, count(DISTINCT c.value) AS n FROM u GROUP BY 1) SELECT cue_id, n AS n_entities, sha256('entities: ' || coalesce(entities, '') || chr(10) || 'clauses: ' || len(predicate.all_of)) AS text_sha FROM k JOIN e USING (cue_id)""",
)
def query_texts(spark, d):
    """PRJ16: the text that asks for a cue: fields in a fixed order, entities sorted and once each."""
    k = table(spark, d, "cue_v2").where("predicate is not null").select("cue_id", "predicate").dropDuplicates(["cue_id"])
    entities = F.array_sort(F.array_distinct(F.array_compact(F.transform("predicate.all_of", lambda c: c["value"]))))
    text = F.concat(F.lit("entities: "), F.array_join(entities, "; "), F.lit("\nclauses: "), F.size("predicate.all_of").cast("string"))
    return k.where(F.size("predicate.all_of") > 0).select("cue_id", F.size(entities).alias("n_entities"), F.sha2(text, 256).alias("text_sha"))


@query(
    "supplied_sets",
    """WITH s AS (SELECT DISTINCT o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey), k AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
       SELECT o_orderkey, count(*) AS n_asked, count(*) FILTER (s_suppkey IS NULL) AS n_outside, count(*) FILTER (s_suppkey IS NULL) = 0 AS contained FROM s LEFT JOIN k ON s_suppkey = l_suppkey GROUP BY 1""",
)
def supplied_sets(spark, d):
    """JN11: is a set of ids contained in what is supplied, and how many lie outside; a join on elements, no list."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).distinct().join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    k = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", F.lit(True).alias("there"))
    return s.join(k, "s_suppkey", "left").groupBy("o_orderkey").agg(F.count("*").alias("n_asked"), F.count_if(F.col("there").isNull()).alias("n_outside"), F.bool_and(F.col("there").isNotNull()).alias("contained"))


@query(
    "audited_sides",
    """WITH c AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT doc_id + CASE WHEN doc_id % 41 = 0 THEN 100000000 ELSE 0 END AS doc_id, count(*) AS n FROM subject_label GROUP BY 1)
       SELECT doc_id, CASE WHEN c.n IS NULL THEN 'unknown' WHEN a.n > 1 THEN 'duplicate' WHEN a.n IS NULL THEN 'not_audited' ELSE 'accepted' END AS status FROM c FULL JOIN a USING (doc_id)""",
)
def audited_sides(spark, d):
    """JN9: candidates against their audit: rows that audit nothing known, that audit twice, and what is left."""
    c = table(spark, d, "documents").groupBy("doc_id").agg(F.count("*").alias("n_candidate"))
    off = F.col("doc_id") + F.when(F.col("doc_id") % 41 == 0, 100_000_000).otherwise(0)
    a = table(spark, d, "subject_label").select(off.alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_audit"))
    status = F.when(F.col("n_candidate").isNull(), "unknown").when(F.col("n_audit") > 1, "duplicate").when(F.col("n_audit").isNull(), "not_audited").otherwise("accepted")
    return c.join(a, "doc_id", "full_outer").select("doc_id", status.alias("status"))


@query(
    "dataset_card",
    """WITH a AS (SELECT DISTINCT atom_id, participant_source_id, session_id, local_end_sec - local_start_sec AS sec FROM source_video_atom)
       SELECT '# Dataset' || chr(10) || '- windows: ' || count(*) || chr(10) || '- sessions: ' || count(DISTINCT session_id) || chr(10) || '- participants: ' || count(DISTINCT participant_source_id) || chr(10) || '- hours: ' || printf('%.2f', sum(sec) / 3600) AS card FROM a""",
)
def dataset_card(spark, d):
    """DM15: a card of the data set as text, from one aggregate."""
    a = table(spark, d, "source_video_atom").select("atom_id", "participant_source_id", "session_id", (F.col("local_end_sec") - F.col("local_start_sec")).alias("sec")).dropDuplicates(["atom_id"])
    one = a.agg(F.count("*").alias("w"), F.countDistinct("session_id").alias("s"), F.countDistinct("participant_source_id").alias("p"), (F.sum("sec") / 3600).alias("h"))
    return one.select(F.format_string("# Dataset\n- windows: %d\n- sessions: %d\n- participants: %d\n- hours: %.2f", "w", "s", "p", "h").alias("card"))


@query(
    "disposition_rules",
    """WITH c AS (SELECT DISTINCT cue_id, atom_id, item_index, disposition, predicate IS NOT NULL AND len(predicate.all_of) > 0 AS has_clauses, len(reason_codes) AS n_reasons, list_has_any(list_transform(reason_codes, lambda x: NOT regexp_full_match(x, '[a-z_]+')), [true]) AS odd FROM cue_v2),
       u AS (SELECT atom_id, item_index, count(*) AS n FROM c GROUP BY 1, 2)
       SELECT cue_id, CASE WHEN disposition NOT IN ('accepted_cue', 'ambiguous', 'no_cue', 'unsupported') THEN 'domain' WHEN u.n > 1 THEN 'item_repeated' WHEN disposition = 'accepted_cue' AND NOT coalesce(has_clauses, false) THEN 'accepted_without_clauses'
         WHEN disposition = 'accepted_cue' AND n_reasons > 0 THEN 'accepted_with_reasons' WHEN disposition <> 'accepted_cue' AND has_clauses THEN 'refused_with_clauses' WHEN disposition <> 'accepted_cue' AND NOT coalesce(n_reasons BETWEEN 1 AND 3, false) THEN 'reasons' WHEN coalesce(odd, false) THEN 'reason_pattern' ELSE 'ok' END AS code
       FROM c JOIN u USING (atom_id, item_index)""",
)
def disposition_rules(spark, d):
    """VL20: the rule of its disposition that each cue breaks: clauses, reasons and their pattern, one row for an item."""
    c = table(spark, d, "cue_v2").select("cue_id", "atom_id", "item_index", "disposition", "predicate", "reason_codes").dropDuplicates(["cue_id"])
    clauses = F.coalesce(F.size("predicate.all_of") > 0, F.lit(False)) & F.col("predicate").isNotNull()
    repeated = c.groupBy("atom_id", "item_index").agg(F.count("*").alias("n")).where("n > 1").select("atom_id", "item_index", F.lit(True).alias("again"))
    j = c.join(repeated, ["atom_id", "item_index"], "left")
    accepted, n = F.col("disposition") == "accepted_cue", F.size("reason_codes")
    code = (
        F.when(~F.col("disposition").isin("accepted_cue", "ambiguous", "no_cue", "unsupported"), "domain")
        .when(F.col("again"), "item_repeated")
        .when(accepted & ~clauses, "accepted_without_clauses")
        .when(accepted & (n > 0), "accepted_with_reasons")
        .when(~accepted & clauses, "refused_with_clauses")
        .when(~accepted & ~F.coalesce(n.between(1, 3), F.lit(False)), "reasons")
        .when(F.exists("reason_codes", lambda x: ~x.rlike("^[a-z_]+$")), "reason_pattern")
    )
    return j.select("cue_id", F.coalesce(code, F.lit("ok")).alias("code"))


@query(
    "terminal_order",
    """WITH e AS (SELECT user_id, event_id, event_type, event_type IN ('purchase', 'error') AS terminal FROM events), w AS (SELECT *, coalesce(bool_or(terminal) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM e)
       SELECT user_id, count(*) FILTER (terminal) AS n_terminal, count(*) FILTER (terminal AND closed) AS n_terminal_again, count(*) FILTER (NOT terminal AND closed) AS n_after, count(DISTINCT event_type) FILTER (terminal) > 1 AS mixed FROM w GROUP BY 1""",
)
def terminal_order(spark, d):
    """LG2, VL17, VL23: how often an id ends, ends again, goes on after its end, or ends in two ways; only the first end is looked for."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("event_type").isin("purchase", "error").alias("terminal"))
    end = e.where("terminal").groupBy("user_id").agg(F.min("event_id").alias("first_end"))
    j = e.join(end, "user_id", "left").withColumn("closed", F.coalesce(F.col("event_id") > F.col("first_end"), F.lit(False)))
    return j.groupBy("user_id").agg(
        F.count_if("terminal").alias("n_terminal"), F.count_if(F.col("terminal") & F.col("closed")).alias("n_terminal_again"), F.count_if(~F.col("terminal") & F.col("closed")).alias("n_after"),
        (F.countDistinct(F.when(F.col("terminal"), F.col("event_type"))) > 1).alias("mixed"),
    )


_TASKS = f"""{_SHARDED}, m AS (SELECT shard // 2 AS task, min(shard) AS shard_start, max(shard) + CASE WHEN shard // 2 = 1 THEN 1 ELSE 0 END AS shard_end, count(*) AS n_items FROM s GROUP BY 1)"""


@query(
    "task_ranges",
    f"""WITH {_TASKS} SELECT task, shard_start, shard_end, n_items, CASE WHEN shard_end < shard_start THEN 'empty' WHEN shard_end - shard_start >= 10 THEN 'too_wide' WHEN lead(shard_start) OVER (ORDER BY task) <= shard_end THEN 'overlap'
        WHEN lead(shard_start) OVER (ORDER BY task) > shard_end + 1 THEN 'gap' ELSE 'ok' END AS code FROM m""",
)
def task_ranges(spark, d):
    """VL15, LG12: tasks of two shards must follow each other without gap and overlap; one range is planted too long."""
    m = _sharded(spark, d).groupBy(F.floor(F.col("shard") / 2).cast("int").alias("task")).agg(F.min("shard").alias("shard_start"), F.max("shard").alias("hi"), F.count("*").alias("n_items"))
    m = m.withColumn("shard_end", F.col("hi") + F.when(F.col("task") == 1, 1).otherwise(0)).drop("hi")
    # The next task by an equi-join on its number, not by a window over all tasks.
    after = m.select((F.col("task") - 1).alias("task"), F.col("shard_start").alias("next_start"))
    code = F.when(F.col("shard_end") < F.col("shard_start"), "empty").when(F.col("shard_end") - F.col("shard_start") >= 10, "too_wide").when(F.col("next_start") <= F.col("shard_end"), "overlap").when(F.col("next_start") > F.col("shard_end") + 1, "gap").otherwise("ok")
    return m.join(after, "task", "left").select("task", "shard_start", "shard_end", "n_items", code.alias("code"))


@query(
    "wave_closure",
    f"""WITH {_SHARDED}, c AS (SELECT DISTINCT atom_id FROM cue_v2), t AS (SELECT shard, count(*) AS total, count(c.atom_id) AS done FROM s LEFT JOIN c USING (atom_id) GROUP BY 1)
        SELECT shard // 3 AS wave, count(*) AS n_shards, count(*) FILTER (done = total) AS n_complete, count(*) FILTER (done = 0) AS n_untouched, CAST(sum(total - done) AS BIGINT) AS n_open, bool_and(done = total) AS closed, min(shard) FILTER (done < total) AS resume_at FROM t GROUP BY 1""",
)
def wave_closure(spark, d):
    """SS7, LG10-11, VL19: waves of three shards: complete and untouched shards, what is open, where to go on, whether the wave is closed."""
    done = table(spark, d, "cue_v2").select("atom_id", F.lit(True).alias("there")).distinct()
    p = _sharded(spark, d).join(done, "atom_id", "left").groupBy("shard").agg(F.count("*").alias("total"), F.count("there").alias("done"))
    complete = F.col("done") == F.col("total")
    return p.groupBy(F.floor(F.col("shard") / 3).cast("int").alias("wave")).agg(
        F.count("*").alias("n_shards"), F.count_if(complete).alias("n_complete"), F.count_if(F.col("done") == 0).alias("n_untouched"), F.sum(F.col("total") - F.col("done")).alias("n_open"), F.bool_and(complete).alias("closed"), F.min(F.when(~complete, F.col("shard"))).alias("resume_at")
    )


@query(
    "manifest_refs",
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY 1), m AS (SELECT o_orderkey AS k, CAST(o_orderkey % 5 + 1 AS BIGINT) AS authorised FROM orders WHERE o_orderkey % 97 <> 0)
       SELECT coalesce(l.k, m.k) AS k, CASE WHEN m.k IS NULL THEN 'not_in_manifest' WHEN l.k IS NULL THEN 'no_event' WHEN n > authorised THEN 'more_events' WHEN amount > 50 * authorised THEN 'over_cap' ELSE 'ok' END AS code FROM l FULL JOIN m USING (k)""",
)
def manifest_refs(spark, d):
    """VL22: events name only what the manifest has, not more often than it allows, and stay below its cap."""
    ledger = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("amount"))
    manifest = table(spark, d, "orders").where("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5 + 1).alias("authorised"))
    code = F.when(F.col("authorised").isNull(), "not_in_manifest").when(F.col("n").isNull(), "no_event").when(F.col("n") > F.col("authorised"), "more_events").when(F.col("amount") > 50 * F.col("authorised"), "over_cap").otherwise("ok")
    return ledger.join(manifest, "k", "full_outer").select("k", code.alias("code"))


@query(
    "receipts",
    """WITH p AS (SELECT session_id, count(DISTINCT segment_id) AS received, count(DISTINCT segment_id) FILTER (parse_status = 'ok') AS validated, count(DISTINCT segment_id) FILTER (parse_status = 'error') AS failed, count(DISTINCT segment_id) FILTER (parse_status LIKE 'discarded%') AS set_aside,
         bool_and((start_sec IS NULL) = (end_sec IS NULL)) AS both_or_none FROM segments GROUP BY 1)
       SELECT session_id, received, validated, failed, set_aside, received = validated + failed + set_aside AND both_or_none AS balanced FROM p""",
)
def receipts(spark, d):
    """VL16: what each session received is what was validated, failed or set aside, and two fields are there together or not at all."""
    s = table(spark, d, "segments").select("session_id", "segment_id", "parse_status", "start_sec", "end_sec").dropDuplicates(["segment_id"])
    status = F.col("parse_status")
    p = s.groupBy("session_id").agg(
        F.count("*").alias("received"), F.count_if(status == "ok").alias("validated"), F.count_if(status == "error").alias("failed"), F.count_if(status.startswith("discarded")).alias("set_aside"), F.bool_and(F.col("start_sec").isNull() == F.col("end_sec").isNull()).alias("both")
    )
    return p.withColumn("balanced", (F.col("received") == F.col("validated") + F.col("failed") + F.col("set_aside")) & F.col("both")).drop("both")


_STATES = ("never_created", "active_unreminded", "active_reminded", "completed", "cancelled", "expired", "illegal")
_ROLES = ("creation", "trigger", "completed", "cancelled", "expired", "lure", "background")


@query(
    "policy_table",
    f"""SELECT s AS state, r AS role, CASE WHEN s = 'illegal' THEN s WHEN r = 'creation' THEN CASE WHEN s = 'never_created' THEN 'active_unreminded' ELSE 'illegal' END WHEN r IN ('completed', 'cancelled', 'expired') THEN CASE WHEN s = 'active_unreminded' THEN r ELSE 'illegal' END
        WHEN r = 'trigger' AND s = 'active_unreminded' THEN 'active_reminded' ELSE s END AS next_state FROM (SELECT unnest({list(_STATES)!r}) AS s), (SELECT unnest({list(_ROLES)!r}) AS r)""",
)
def policy_table(spark, d):
    """DM6, DM9: the machine as a table, every state under every role."""
    rows = [(s, r, REMINDER.states[REMINDER.table(r)[REMINDER.states.index(s)]]) for s in _STATES for r in _ROLES]
    return spark.createDataFrame(rows, "state string, role string, next_state string")


@query(
    "rule_ids",
    """WITH r AS (SELECT DISTINCT cue_id, disposition, predicate FROM cue_v2 WHERE disposition = 'accepted_cue' AND predicate IS NOT NULL), x AS (SELECT cue_id, unnest(range(len(predicate.all_of)))::INTEGER AS i, unnest(predicate.all_of) AS c FROM r),
       y AS (SELECT 'rule_' || substr(sha256(concat_ws('|', cue_id, i, coalesce(c.dimension, ''), coalesce(c.operator, ''), coalesce(c.value, ''))), 1, 16) AS rule_id, cue_id, c.dimension AS dimension, c.operator AS operator FROM x)
       SELECT rule_id, cue_id, dimension, operator, count(*) OVER (PARTITION BY rule_id) = 1 AS is_unique FROM y""",
)
def rule_ids(spark, d):
    """DM6: accepted clauses as rules with ids that must be unique over all cues."""
    one = table(spark, d, "cue_v2").where("disposition = 'accepted_cue' and predicate is not null").select("cue_id", "predicate").dropDuplicates(["cue_id"])
    x = one.select("cue_id", F.posexplode("predicate.all_of").alias("i", "c"))
    named = F.concat_ws("|", "cue_id", F.col("i").cast("string"), *(F.coalesce(F.col(f"c.{k}"), F.lit("")) for k in ("dimension", "operator", "value")))
    y = stage(x.select(F.concat(F.lit("rule_"), F.substring(F.sha2(named, 256), 1, 16)).alias("rule_id"), "cue_id", F.col("c.dimension").alias("dimension"), F.col("c.operator").alias("operator")), "rules")
    many = y.groupBy("rule_id").agg((F.count("*") == 1).alias("is_unique"))
    return y.join(many, "rule_id")
