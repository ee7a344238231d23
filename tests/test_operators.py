"""Operators on small tables: defined results for nulls, ties, repetitions and empty inputs; brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import char_trigrams
from tidemark.operators import align, allocate, automaton, evidence, graph, intervals, ledger, prefix, retrieve, scenarios, setsim, statistics, validate
from tidemark.operators.allocate import floor_quotas
from tidemark.operators.graph import connected_components
from tidemark.operators.retrieve import minibatch_centres, minibatch_clustered
from tidemark.plans import staging


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- intervals -------------------------------------------------------------------------------------


def islands(windows):
    out = {}
    for k in {w[0] for w in windows if w[0] is not None}:
        merged = []
        for s, e in sorted((s, e) for x, s, e in windows if x == k and s is not None and e is not None and e > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out[k] = merged
    return out


@pytest.mark.parametrize("bucket", [7, 50, 3_600_000])
def test_periods_and_gaps_equal_brute_force(spark, bucket):
    rng = random.Random(bucket)
    w = [(rng.choice("abc"), (s := rng.randrange(-200, 400)), s + rng.randrange(-3, 25)) for _ in range(120)]
    w += [("a", None, 5), ("a", 5, None), (None, 1, 2), ("d", 3, 3), ("e", 0, 300), ("e", 0, 300)]
    df = spark.createDataFrame(w, "key string, s bigint, e bigint").withColumn("bucket", F.lit("clash"))
    want = islands(w)
    assert rows(intervals.periods(df, "key", "s", "e", bucket)) == sorted([(k, i + 1, s, e) for k, m in want.items() for i, (s, e) in enumerate(m)], key=str)
    assert rows(intervals.gaps(df, "key", "s", "e", bucket)) == sorted([(k, a[1], b[0]) for k, m in want.items() for a, b in zip(m, m[1:])], key=str)


def test_intervals_of_nothing(spark):
    none = spark.createDataFrame([], "key string, s bigint, e bigint")
    assert rows(intervals.gaps(none, "key", "s", "e")) == [] and rows(intervals.periods(none, "key", "s", "e")) == []


def test_milliseconds(spark):
    df = spark.sql("select 1.2345d a, double('nan') b, cast(null as double) c")
    assert tuple(df.select(*[intervals.milliseconds(F.col(c)) for c in "abc"]).first()) == (1235, None, None)


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(3)
    make = lambda p, n: [(f"{p}{i}", rng.choice("xy"), (s := round(rng.uniform(0, 300), 2)), round(s + rng.uniform(0, 90), 2)) for i in range(n)]
    a, b = make("a", 40) + [("a_", None, 1.0, 2.0), ("a!", "x", None, 2.0)], make("b", 40) + [("b_", None, 1.0, 2.0)]
    schema = "id string, k string, start_sec double, end_sec double"
    got = align.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], 2.0, band=20.0).select("l_id", "r_id")
    want = [(x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and None not in x and x[2] - y[3] <= 2.0 and y[2] - x[3] <= 2.0]
    assert rows(got) == sorted(want)


# --- graph, similarity, allocation -----------------------------------------------------------------


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [(f"m{rng.randrange(40)}", f"m{rng.randrange(40)}") for _ in range(30)] + [("hub", f"h{i}") for i in range(50)] + [("solo", "solo"), (None, "x")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u and v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = graph.connected_components(spark.createDataFrame(edges, "u string, v string"))
    assert rows(got) == sorted((n, find(n)) for n in parent)
    assert rows(graph.connected_components(spark.createDataFrame([], "u string, v string"))) == []


@pytest.mark.parametrize("t", ["0.5", "0.92"])
def test_set_similarity_equals_brute_force(spark, monkeypatch, t):
    rng = random.Random(5)
    base = [[f"t{rng.randrange(30)}" for _ in range(12)] for _ in range(8)]
    data = [(f"k{i}", rng.choice("pq"), rng.choice("xyz"), [w for w in rng.choice(base) if rng.random() > 0.1]) for i in range(60)] + [("e", "p", "x", []), ("n", "p", "y", None)]
    df = spark.createDataFrame(data, "key string, block string, session string, tokens array<string>")
    got = {(r.key_1, r.key_2) for r in setsim.set_similarity_pairs(df, "key", "tokens", t, ["block"], "session").collect()}
    want = set()
    for i, a in enumerate(data):
        for b in data[i + 1 :]:
            x, y = set(a[3] or []), set(b[3] or [])
            if x and y and a[1] == b[1] and a[2] != b[2] and len(x & y) >= float(t) * len(x | y) - 1e-12:
                want.add(tuple(sorted((a[0], b[0]))))
    assert got == want
    # Tokens as numbers: ordered in place, or by a join where too many are different.
    numbered = df.withColumn("tokens", F.transform("tokens", lambda x: F.xxhash64(x)))
    for known in (setsim.KNOWN, 0):
        monkeypatch.setattr(setsim, "KNOWN", known)
        assert {(r.key_1, r.key_2) for r in setsim.set_similarity_pairs(numbered, "key", "tokens", t, ["block"], "session").collect()} == want
    assert setsim.set_similarity_pairs(numbered.where("false"), "key", "tokens", t).count() == 0


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 0)], "k string, n bigint")
    got = {r.k: r.quota for r in allocate.largest_remainder(df, ["k"], "n", 7).collect()}
    assert sum(got.values()) == 7 and got == {"a": 3, "b": 2, "c": 2, "d": 0}
    assert {r.quota for r in allocate.largest_remainder(df, ["k"], "n", 100).collect()} == {5, 3, 0}
    assert allocate.largest_remainder(df.limit(0), ["k"], "n", 7).count() == 0


def test_numbered(spark):
    df = spark.range(1000).withColumn("x", F.hash("id"))
    got = allocate.numbered(df.repartition(7), ["x", "id"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1000)) and [(r.x, r.id) for r in got] == sorted((r.x, r.id) for r in got)


def test_greedy_disjoint_equals_one_after_the_other(spark):
    rng = random.Random(6)
    data = [(i, rng.randrange(5), [rng.randrange(40) for _ in range(3)]) for i in range(50)]
    used, want = set(), []
    for i, o, items in sorted(data, key=lambda r: (r[1], r[0])):
        if not used & set(items):
            want.append(i)
            used |= set(items)
    got = allocate.greedy_disjoint(spark.createDataFrame(data, "k int, o int, items array<int>"), "k", ["o"], "items")
    assert [r[0] for r in rows(got)] == sorted(want, key=lambda x: str((x,)))


def test_packages(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([3, 3, 9, 1, 1, 1, 1, 1, 20])], "shard int, position int, size int")
    got = [(r.position, r.package, r.oversize) for r in allocate.greedy_packages(df, "shard", "position", "size", 5, 10).orderBy("position").collect()]
    assert [g[1] for g in got] == [0, 0, 1, 1, 2, 2, 2, 2, 3] and got[-1][2] and not got[0][2]


# --- retrieval -------------------------------------------------------------------------------------


def test_topk_in_blocks(spark):
    rng = random.Random(7)
    data = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, [1.0, 0.0, 0.0, 0.0]), (61, [1.0, 0.0, 0.0, 0.0]), (62, None)]
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    q = df.where("id % 20 = 0")
    got = {}
    for r in retrieve.dense_topk(q, df, "id", "v", 5, block=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    vectors = {r.id: r.v for r in df.collect() if r.v}
    for k, found in got.items():
        score = lambda i: sum(a * b for a, b in zip(vectors[k], vectors[i]))  # noqa: B023, E731
        assert [i for _, i in sorted(found)] == sorted((i for i in vectors if i != k), key=lambda i: (-score(i), i))[:5]


def test_survivors_equal_greedy(spark):
    rng = random.Random(8)
    pairs = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(80)) if a < b]
    alive = set()
    for i in range(60):
        if not any((a in alive and b == i) or (b in alive and a == i) for a, b in pairs):
            alive.add(i)
    got = retrieve.survivors(spark.range(60), "id", ["id"], spark.createDataFrame(pairs, "id_1 bigint, id_2 bigint"))
    assert {r.id for r in got.collect() if r.survives} == alive


def test_sparse_ranks_zero_scores(spark):
    df = spark.createDataFrame([(1, {"a": 1.0}), (2, {"a": 2.0}), (3, {"b": 1.0}), (4, {})], "id bigint, w map<string,double>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieve.sparse_topk(df.where("id = 1"), df, "id", "w", 3).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (1, 3): 4}


# --- machines, scenarios ---------------------------------------------------------------------------


def test_machine_over_buckets(spark):
    rng = random.Random(9)
    symbols = ["creation", "completed", "cancelled", "trigger", "lure", None]
    data = [(rng.choice("ab"), i, rng.choice(symbols)) for i in range(60)]
    m, want = automaton.REMINDER, []
    for k in "ab":
        state = 0
        for key, i, s in data:
            if key == k:
                after = m.table(s)[state] if s else state
                want.append((k, i, m.states[state], m.states[after]))
                state = after
    df = spark.createDataFrame(data, "k string, i int, s string")
    got = automaton.run(df, m, "k", ["i"], "s", F.floor(F.col("i") / 7)).select("k", "i", "state_before", "state_after")
    assert rows(got) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["never_created", "completed", "cancelled", "expired"])
def test_scenarios_flip(spark, kind):
    seeds = spark.createDataFrame([("s1", "t", "l1", "l2", kind)], "seed_id string, trigger_atom_id string, lure_1 string, lure_2 string, negative_type string")
    events = scenarios.expand(seeds)
    assert events.groupBy("log_id").count().count() == 6
    assert events.where("role = 'trigger'").count() == 6 and events.where("role = 'lure'").count() == 12
    r = automaton.run(events, automaton.REMINDER, "log_id", ["position"], "role", F.floor(F.col("position") / 10)).where("role = 'trigger'")
    acts = r.withColumn("acts", F.col("state_before") == "active_unreminded")
    assert tuple(scenarios.flips(acts, "pair_id", "branch", "acts").first()) == (3, 3, 3, 1.0)


# --- evidence, validation, ledger, statistics ------------------------------------------------------


def test_unsatisfied(spark):
    df = spark.sql("select array(named_struct('operator', 'present', 'value', 'Cup'), named_struct('operator', 'absent', 'value', 'cup'), named_struct('operator', 'eq', 'value', ''), named_struct('operator', 'absent', 'value', null)) c, 'a cup' h")
    assert df.select(evidence.unsatisfied(F.col("c"), F.col("h"))).first()[0] == [1, 2]


def test_grounding(spark):
    cases = [("transcript", "red cup", "cup", None), ("transcript", "blue", "blue", "CROSS_FIELD_EVIDENCE"), ("x", "red", "red", "CROSS_FIELD_EVIDENCE"), ("transcript", "green", "green", "SPAN_NOT_CONTIGUOUS"), ("transcript", "red cup", "pan", "VALUE_NOT_SUPPORTED"), (None, None, None, "CROSS_FIELD_EVIDENCE")]
    df = spark.createDataFrame([(f, s, v, "a red cup", "blue mug") for f, s, v, _ in cases], "f string, s string, v string, t string, d string")
    got = [r[0] for r in df.select(evidence.grounding_code(*[F.col(c) for c in "fsvtd"])).collect()]
    assert got == [c[3] for c in cases]


def test_compact_answers(spark):
    df = spark.createDataFrame([("a", '[{"n":1,"f":"t","x":"s","p":[["object","present","cup"]],"c":80},{"n":2,"f":"?"}]'), ("b", "no json"), ("c", None)], "k string, body string")
    got = rows(evidence.expand_compact(df, "k", "body", {"t": "transcript"}).select("k", "status"))
    assert got == [("a", "invalid_item"), ("a", "ok"), ("b", "invalid_json"), ("c", "invalid_json")]


def test_checks_fail_on_unknown(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, x int")
    got = validate.checks(df, "id", {"positive": F.col("x") > 0})
    assert sorted(r.failure_id for r in got.collect()) == ["2", "3"]
    with pytest.raises(ValueError):
        validate.gate(got)
    validate.gate(got.limit(0))


def test_schema_issues(spark):
    got = {(r.issue_type, r.failure_id) for r in validate.schema_issues(spark.range(1).withColumn("bad", F.lit(1)), {"id": "int", "x": "string"}, ("bad",)).collect()}
    assert got == {("column_type", "id"), ("missing_column", "x"), ("forbidden_column", "bad")}


def test_bijection_and_contiguity(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "z")], "p string, q string")
    assert rows(validate.bijection(df, "p", "q").select("issue_type", "failure_id")) == [("many_q", "a")]
    pos = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 0), ("c", 0)], "k string, n int")
    assert sorted(r.failure_id for r in validate.contiguous(pos, "k", "n").collect()) == ["b", "c"]


def test_ledger(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    assert rows(ledger.usage_totals(df, ["k"], ["v"])) == [("a", 2, None), ("b", 1, 2.0)]
    done = spark.createDataFrame([("a", "no"), ("a", "yes"), ("b", "other")], "k string, o string")
    got = ledger.coverage(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", done, "o", ("yes", "no"))
    assert rows(got) == [("a", "yes"), ("b", "missing"), ("c", "missing")]


def test_occupancy(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "k string")
    r = statistics.occupancy(df, "k").first()
    assert (r.n_values, r.n_rows, r.largest_share) == (2, 4, 0.5) and abs(r.entropy - 0.6931471805599453) < 1e-12
    assert "| n_rows | 4 |" in statistics.card("x", r.asDict())


def _unit_vectors(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_reservoir_of_a_large_cluster_is_the_same(spark):
    v = _unit_vectors(300, 1)
    df = spark.createDataFrame([(i, "hot" if i % 3 else "rare", v[i].tolist()) for i in range(300)], "id bigint, g string, v array<float>").repartition(5)
    whole = {tuple(r) for r in retrieve.reservoirs(df, "id", "g", "v", 10).collect()}
    assert whole == {tuple(r) for r in retrieve.reservoirs(df, "id", "g", "v", 10, block=120).collect()} and len(whole) == 20


def test_survivor_spacing_finds_a_row_wrongly_kept(spark):
    v = _unit_vectors(40, 2)
    df = spark.createDataFrame([(i, f"g{i % 2}", v[i].tolist()) for i in range(40)], "id bigint, g string, v array<float>")
    kept = spark.createDataFrame([(i, i % 5 != 0) for i in range(40)], "id bigint, survives boolean")
    got = {r.g: (r.n_survivors, r.min_distance) for r in retrieve.survivor_spacing(df, "id", "g", "v", kept).collect()}
    for g in (0, 1):
        ids = [i for i in range(40) if i % 5 and i % 2 == g]
        least = min(1 - float(v[i].astype(float) @ v[j].astype(float)) for i in ids for j in ids if i < j)
        assert got[f"g{g}"][0] == len(ids) and abs(got[f"g{g}"][1] - least) < 1e-6


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(None, 4), (5, None), (7, 7)]
    df = spark.createDataFrame(pairs, "u int, v int")
    one = sorted(map(tuple, connected_components(df).collect()))
    assert one == sorted(map(tuple, connected_components(df, one_task=0).collect())) and all(b <= a for a, b in one)
    assert connected_components(df.where("false")).count() == 0


def test_trigram_numbers_are_the_substrings(spark):
    texts = ["", "a", "ab", "abc", "añ😀中b", "aaaa", None, "x" * 5000]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(char_trigrams("t")).collect()]
    for t, g in zip(texts, got):
        if t is None:
            assert g is None
            continue
        want = [t[i : i + 3] for i in range(len(t) - 2)] or ([t] if t else [])
        assert len(g) == len(want) and len(set(g)) == len(set(want))
    assert len({got[1][0], got[2][0], got[3][0]}) == 3


def test_staging_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class sparkContext:
            applicationId, master = "app", "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        staging.shared_dir(Cluster)


def test_released_and_cleared_tables_are_gone(spark):
    df = staging.stage(spark.range(5), "gone")
    where = df._staged_at.removeprefix("file://")
    assert os.path.exists(where) and df.count() == 5
    staging.release(df)
    assert not os.path.exists(where)


def test_floor_quotas(spark):
    df = spark.createDataFrame([("a", 100), ("b", 2), ("c", 50)], "k string, n bigint")
    got = {r.k: r.quota for r in floor_quotas(df, ["k"], "n", 40, 5).collect()}
    assert got["b"] == 2 and sum(got.values()) == 40 and got["a"] > got["c"] >= 5
    assert {r.k: r.quota for r in floor_quotas(df, ["k"], "n", 3, 5).collect()} == {"a": 5, "b": 2, "c": 5}


def test_minibatch_finds_what_is_apart(spark):
    rng = np.random.default_rng(4)
    where = rng.normal(size=(6, 8)) * 10
    v = np.concatenate([c + rng.normal(size=(40, 8)) * 0.1 for c in where])
    assert len({tuple(np.round(c)) for c in minibatch_centres(v, 6)}) == 6
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id bigint, v array<double>")
    got = {r.id: r.cluster for r in minibatch_clustered(df, "id", "v", 6).collect()}
    assert 999 not in got and all(len({got[40 * c + i] for i in range(40)}) == 1 for c in range(6)) and len(set(got.values())) == 6
    assert minibatch_clustered(df.where("false"), "id", "v", 6).count() == 0


def test_running_aggregates_across_partitions(spark):
    rng = random.Random(8)
    data = [(k, i, rng.choice([None, rng.randrange(100)])) for k in ("a", "b", None) for i in range(rng.randrange(60, 90))] + [("hot", i, i % 17) for i in range(900)]
    rng.shuffle(data)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = prefix.ranged(spark.createDataFrame(data, "k string, o int, v int"), "k", ["o"])
        assert rows.where("k = 'hot'").select(prefix.PART).distinct().count() > 1
        out = prefix.running_sum(rows, "k", ["o"], F.col("v"), "s")
        out = prefix.running_max(out, "k", ["o"], F.col("v"), "m", inclusive=False)
        out = prefix.first_or_last(out, "k", ["o"], F.col("v"), "f", last=False)
        got = {(r.k, r.o): (r.s, r.m, r.f, r.l) for r in prefix.first_or_last(out, "k", ["o"], F.col("v"), "l", last=True, inclusive=False).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(data)
    for k in ("a", "b", None, "hot"):
        seen = []
        for _, o, v in sorted((x for x in data if x[0] == k), key=lambda x: x[1]):
            before = [x for x in seen if x is not None]
            seen.append(v)
            upto = [x for x in seen if x is not None]
            assert got[k, o] == (sum(upto) if upto else None, max(before) if before else None, upto[0] if upto else None, before[-1] if before else None)


def test_close_pairs_equal_brute_force(spark):
    rng = random.Random(15)
    base = [[rng.randrange(1 << 40) for _ in range(n)] for n in (1, 3, 11, 12, 13, 25, 60, 300)]
    data = []
    for i in range(240):
        tokens = [x for x in rng.choice(base) if rng.random() > 0.02] + [rng.randrange(9) for _ in range(rng.choice((0, 0, 1, 4)))]
        data.append((i, rng.choice("pq"), tokens))
    df = staging.stage(spark.createDataFrame(data, "i bigint, block string, tokens array<bigint>"))
    for t in ("0.92", "0.8"):
        got = {tuple(r) for r in setsim.close_pairs(df, "i", F.col("tokens"), t, ["block"]).collect()}
        want = set()
        for i, p, x in data:
            for j, q, y in data[i + 1 :]:
                both, union = len(set(x) & set(y)), len(set(x) | set(y))
                if p == q and x and y and both >= float(t) * union - 1e-12:
                    want.add((i, j, both, union))
        assert got == want and len(want) > 100
    assert setsim.close_pairs(df.where("false"), "i", F.col("tokens"), "0.92", ["block"]).count() == 0


def test_components_write_no_sets_and_count_copies(spark, monkeypatch, tmp_path):
    from tidemark.plans import allocation_queries

    text = "a person with a cap fills the spare label printer near the window seat of the hall "
    rows = [(f"a{i}", "P", "D", f"s{i % 3}", f"g{i % 3}", None, text + ("again" if i % 2 else "again.")) for i in range(12)]
    rows += [("b", "P", "D", "s9", "g9", None, "nothing like the other ones"), ("c", "P", "E", "s8", "g8", None, text)]
    names = "atom_id string, participant_source_id string, source_day string, session_id string, source_group_id string, world_event_id string, visible_text string"
    df = spark.createDataFrame(rows + rows[:3], names)
    monkeypatch.setattr(allocation_queries, "table", lambda *_: df)
    written = []
    for where in (setsim, allocation_queries):
        monkeypatch.setattr(where, "stage", lambda x, name="stage", plain=staging.stage: written.append(x.schema.simpleString()) or plain(x, name))
    # Three sessions of four atoms each: 66 pairs less 18 within a session, one component of the three.
    assert [tuple(r) for r in allocation_queries.component_links(spark, "").collect()] == [(10, 3, 7, 48)]
    assert len(allocation_queries.near_dup_pairs(spark, "").collect()) == 48
    assert not [x for x in written if "array" in x]


def test_components_broadcast_nothing_that_grows(spark, monkeypatch):
    from tidemark.plans import allocation_queries

    names = "atom_id string, participant_source_id string, source_day string, session_id string, source_group_id string, world_event_id string, visible_text string"
    text = "a person with a cap fills the spare label printer near the window seat of the hall again"
    df = spark.createDataFrame([(f"a{i}", "P", "D", f"s{i % 3}", f"g{i % 3}", None, text + "." * (i % 2)) for i in range(12)], names)
    monkeypatch.setattr(allocation_queries, "table", lambda *_: df)
    plans = []
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    for where in (setsim, allocation_queries, graph):
        monkeypatch.setattr(where, "stage", lambda x, name="stage", plain=staging.stage: plans.append(plan(x)) or plain(x, name))
    # Small tables are broadcast wherever the plan leaves it to their size; only bounded lists of ids may be.
    monkeypatch.setattr(graph.connected_components, "__defaults__", ("u", "v", 60, 1))
    for few in (0, setsim.FEW):
        plans.clear()
        monkeypatch.setattr(setsim, "FEW", few)
        out = allocation_queries.component_links(spark, "")
        joins = [x for p in [*plans, plan(out)] for x in p.splitlines() if "BroadcastHashJoin" in x]
        assert bool(joins) == (few > 0) and all("LeftSemi" in x for x in joins)
        assert any("SortMergeJoin" in p for p in plans)
        assert [tuple(r) for r in out.collect()] == [(6, 1, 5, 48)]
