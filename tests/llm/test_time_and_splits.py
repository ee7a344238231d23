import random

import numpy as np
import pytest

from tidemark.llm import p3_nearest_time as p3
from tidemark.llm import p5_group_split as p5


def test_learned_index_is_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 700):
        for scale in (3, 50, 100_000):
            times = np.sort(rng.integers(0, scale * n, n))
            wanted = rng.integers(-5, scale * n + 5, 400)
            assert (p3.positions(times, wanted) == np.searchsorted(times, wanted)).all()
            firsts, places, slopes = p3.learn(times)
            for k, (t, p, s) in enumerate(zip(firsts, places, slopes)):
                end = places[k + 1] if k + 1 < len(places) else n
                assert (np.abs(p + s * (times[p:end] - t) - np.arange(p, end)) <= p3.ERROR + 1e-6).all()


@pytest.mark.parametrize("width", [3_000, 50_000])
def test_matches_equal_brute_force(spark, width):
    rng = random.Random(2)
    refs = [(f"a{i:03d}", rng.choice("st"), rng.randrange(0, 200_000)) for i in range(150)] + [("a000", "s", 5), ("n1", None, 5), ("n2", "s", None)]
    refs += [("tie2", "s", 300_000), ("tie1", "s", 300_000), ("tie3", "s", 300_020)]
    recs = [(f"r{i:03d}", rng.choice("stu"), rng.randrange(0, 200_000)) for i in range(120)] + [("r!", None, 5), ("r?", "s", None), ("r=", "s", 300_010)]
    a = spark.createDataFrame(refs, "id string, e string, t bigint")
    b = spark.createDataFrame(recs + recs[:7], "id string, e string, t bigint").withColumnRenamed("id", "rid")
    got = {r.rid: r.id for r in p3.nearest(b, a, "e", "rid", "id", b.t * 2, a.t * 2, 2_000, width).collect()}
    for rid, e, t in recs:
        near = sorted((abs(x - t), x, i) for i, f, x in refs if e and f == e and t is not None and x is not None and abs(x - t) <= 2_000)
        assert got[rid] == (near[0][2] if near else None)
    assert len(got) == len(recs)
    assert p3.nearest(b.limit(0), a, "e", "rid", "id", b.t, a.t).count() == 0
    assert p3.nearest(b, a.limit(0), "e", "rid", "id", b.t, a.t).where("id is not null").count() == 0


def atoms(spark, rows):
    return spark.createDataFrame(rows, "atom_id string, source_group_id string, session_id string, world_event_id string, split string")


def test_torn_groups(spark):
    rows = [
        ("a", "g1", "s1", None, "train"), ("b", "g2", "s1", None, " DEV"),  # one session, two splits
        ("c", "g3", "s3", "we_1", "test"), ("d", "g4", "s4", "we_1", "TEST "), ("e", "g4", "s5", "n/a", None),  # one split
        ("f", "g5", "s6", "none", "train"), ("g", "g6", "s7", " ", "dev"),  # placeholders relate nothing
        ("h", None, "s1", None, None), ("i", None, None, None, "train"), ("j", None, None, None, "dev"),
        ("k", "g7", "s8", None, "train"), ("k", "g7", "s8", None, "train"), ("l", "g7", "s9", None, "test"),
    ]
    assert sorted(r[0] for r in p5.torn_groups(atoms(spark, rows)).collect()) == ["g1", "g2", "g7"]
    assert p5.torn_groups(atoms(spark, rows).limit(0)).count() == 0


def test_assignment_keeps_together_and_meets_quotas(spark):
    rng = random.Random(3)
    rows = []
    for c in range(120):
        own = rng.choices(["train", "dev", "test"], [7, 2, 1])[0]
        for i in range(rng.choice([1, 2, 3, 8, 20])):
            rows.append((f"a{c}_{i}", f"g{c}_{i % 2}", f"s{c}_{i // 2}" if i % 4 else f"s{c}_0", f"we_{c}" if i % 3 == 0 else None, own if rng.random() < 0.95 else "dev"))
    rows += [("x", None, None, None, None)]
    got = p5.assignment(atoms(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.groupby("component").new_split.nunique() == 1).all()
    share = got.new_split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["dev"] - 0.15) < 0.03 and abs(share["test"] - 0.15) < 0.03
    again = p5.assignment(atoms(spark, rows[::-1])).toPandas()
    assert dict(zip(got.atom_id, got.new_split)) == dict(zip(again.atom_id, again.new_split))
    assert p5.assignment(atoms(spark, rows).limit(0)).count() == 0


def test_flow_is_cheap():
    # Two pure bundles and one mixed: only what is beyond the quotas moves.
    bundles = [(80, (80, 0, 0)), (10, (0, 10, 0)), (10, (0, 0, 10))]
    flow = p5.solve(bundles)
    loads = [sum(f[j] for f in flow) for j in range(3)]
    assert loads == pytest.approx([70, 15, 15]) and flow[1] == [0, 10, 0] and flow[2] == [0, 0, 10]
    assert p5.solve([]) == [] and p5.rounded([], []) == []
