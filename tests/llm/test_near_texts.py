"""Problems 1 and 4 against brute force, with edits like those of the data and the usual dirt."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import meeting
from tidemark.llm import p1_near_duplicates as p1
from tidemark.llm import p4_split_overlap as p4
from tidemark.llm.textsim import MAX_BITS, MIN_CHARS, bit_sketch, grams, normal, similarity, slices, text_id

_rng = random.Random(0)
WORDS = ["".join(_rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(_rng.randrange(3, 10))) for _ in range(3000)]


def make(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [rng.choice(WORDS) for _ in range(rng.randrange(12, 40))]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                i = rng.randrange(len(w))
                rng.choice([lambda: w.insert(i, "quite"), lambda: w.pop(i), lambda: w.__setitem__(i, "dusty"), lambda: w.__setitem__(i, w[i].upper())])()  # noqa: B023
            out.append(" ".join(w) if rng.random() < 0.8 else "  " + "  ".join(w) + "\n")
    return out[:n]


def near(texts, t):
    good = [(i, normal(x)) for i, x in enumerate(texts) if x is not None and len(normal(x)) >= MIN_CHARS]
    return {(i, j) for k, (i, a) in enumerate(good) for j, b in good[k + 1 :] if similarity(a, b) >= t}


@pytest.fixture(scope="module")
def texts():
    return make(150, 1) + [None, "", "   ", "short text", "x" * 59, "y" * 60, "Y" * 60, "z " * 20_000, "z " * 20_001]


def test_pairs_equal_brute_force(spark, texts):
    data = [(f"a{i:03d}", t, texts[-1 - i], "clash", 1) for i, t in enumerate(texts)]
    data += data[:9]  # delivered again
    df = spark.createDataFrame(data, "atom_id string, dense_caption string, transcript string, h string, k int")
    got = {tuple(r) for r in p1.found(df).collect()}
    n = len(texts)
    want = {("dense_caption", f"a{i:03d}", f"a{j:03d}") for i, j in near(texts, 0.7)}
    want |= {("transcript", *sorted((f"a{n - 1 - i:03d}", f"a{n - 1 - j:03d}"))) for i, j in near(texts, 0.7)}
    assert got <= want
    # The sketches are random: next to none may be missing, and none of those near the top.
    assert len(want - got) <= 0.01 * len(want)
    sure = {("dense_caption", f"a{i:03d}", f"a{j:03d}") for i, j in near(texts, 0.9)}
    assert sure <= got


def test_groups_are_the_components_of_the_pairs(spark, texts):
    data = [(f"a{i:03d}", t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data + data[:4], "atom_id string, dense_caption string, transcript string")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in (tuple(r) for r in p1.found(df).collect()):
        parent[find(b)] = find(a)
    want = {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    got = {}
    for r in p1.groups(df).collect():
        got.setdefault(r.group_id, set()).add(r.atom_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_every_pair_within_the_radius_collides():
    masks = p1.masks()
    from itertools import combinations

    for off in combinations(range(p1.COORDINATES), p1.RADIUS):
        assert any(not set(off) & set(m) for m in masks)
    assert len(masks) == 2 ** (p1.RADIUS + 1) - 1 and min(map(len, masks)) >= 5


def test_bit_sketches_follow_similarity():
    t = [normal(x) for x in make(80, 2)]
    bits = bit_sketch(t)
    for i in range(0, 80, 2):
        expected = (1 - similarity(t[i], t[i + 1])) / 2 * 128
        assert abs(np.bitwise_count(bits[i] ^ bits[i + 1]).sum() - expected) < 25
    assert (bits[0] == bit_sketch([t[0]])[0]).all()
    assert grams("ab") == set()


def test_nothing(spark):
    none = spark.createDataFrame([], "atom_id string, dense_caption string, transcript string")
    assert p1.found(none).count() == 0
    none = spark.createDataFrame([], "atom_id string, participant_source_id string, split string, visible_text string")
    assert p4.found(none).count() == 0 and p4.report(none).count() == 0 and p4.coverage(none).count() == 0


def test_overlaps_equal_brute_force(spark, texts):
    rng = random.Random(3)
    splits = [rng.choice(["train", " Train", "train", "dev", "TEST ", None, "other"]) for _ in texts]
    data = [(f"a{i:03d}", f"P{i % 3}", s, t, "clash") for i, (s, t) in enumerate(zip(splits, texts))]
    df = spark.createDataFrame(data + data[:5], "atom_id string, participant_source_id string, split string, visible_text string, side string")
    clean = [(s or "").strip().lower() for s in splits]
    want = set()
    for i, j in near(texts, 0.7):
        pair = {clean[i], clean[j]}
        if "train" in pair and len(pair) == 2 and pair <= {"train", "dev", "test"}:
            want.add((f"a{i:03d}", f"a{j:03d}", (pair - {"train"}).pop()))
    got = {tuple(r) for r in p4.found(df).collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want) and want
    n = {}
    for a, b, s in got:
        e = a if clean[int(a[1:])] != "train" else b
        n[s, f"P{int(e[1:]) % 3}"] = n.get((s, f"P{int(e[1:]) % 3}"), 0) + 1
    assert {(r.eval_split, r.source): r.n_overlaps for r in p4.report(df).collect()} == n


def test_stock_phrase_does_not_hide_a_copy(spark):
    rng = random.Random(4)
    phrase = "one more thing please do not forget to bring back the "
    data = [(f"a{i:03d}", "P", "train" if i % 2 else "dev", phrase + " ".join(rng.choice(WORDS) for _ in range(8))) for i in range(300)]
    data.append(("b", "P", "dev", data[1][3] + " again"))
    df = spark.createDataFrame(data, "atom_id string, participant_source_id string, split string, visible_text string")
    assert ("a001", "b", "dev") in {tuple(r) for r in p4.found(df).collect()}


def test_coverage_equals_brute_force(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    long, copy, hot = words(400), words(15), "a phrase that stands in very many records "
    rows = [("train", long), ("dev", words(3) + " " + long[200:2300] + " " + words(3)), ("train", copy), ("Test ", copy.upper()), ("train", words(15)), (None, words(15))]
    rows += [(("train", "dev", "train")[i % 3], hot + words(12)) for i in range(60)]
    rows += [("train", long[:120] + words(9)), ("dev", words(9) + copy[-45:]), ("other", long)]
    df = spark.createDataFrame([(f"a{i}", "P", s, t) for i, (s, t) in enumerate(rows)], "atom_id string, participant_source_id string, split string, visible_text string")
    sides = {}
    for s, t in rows:
        if (s or "").strip().lower() in ("train", "dev", "test"):
            sides.setdefault(normal(t), set()).add("train" if s == "train" else "eval")
    windows = {k: {t[i : i + p4.SPAN] for t, s in sides.items() if k in s for i in range(len(t) - p4.SPAN + 1)} for k in ("train", "eval")}
    want = {}
    for t, s in sides.items():
        marks = set()
        for i in range(len(t) - p4.SPAN + 1):
            if any(t[i : i + p4.SPAN] in windows[k] for k in ("train", "eval") if s - {k}):
                marks |= set(range(i, i + p4.SPAN))
        if marks:
            want[text_id(t)] = (len(t), len(marks))
    assert want[text_id(normal(copy))][0] == want[text_id(normal(copy))][1] and want[text_id(normal(long))][1] > 2000
    assert {r.h: (r.n_chars, r.covered) for r in p4.coverage(df).collect()} == want


def test_a_template_does_not_hide_its_pairs(spark):
    rng = random.Random(6)
    data = [(f"a{i:03d}", "P", "train" if i % 4 else "dev", f"the light in the kitchen was {n:04d} steps from the door to the") for i, n in enumerate(rng.sample(range(10_000), 400))]
    df = spark.createDataFrame(data, "atom_id string, participant_source_id string, split string, visible_text string")
    want = {(f"a{i:03d}", f"a{j:03d}", "dev") for i, j in near([r[3] for r in data], 0.7) if (i % 4 == 0) != (j % 4 == 0)}
    got = {tuple(r) for r in p4.found(df).collect()}
    assert len(want) == 30_000 and got <= want and len(want - got) <= 0.002 * len(want)


def at_the_threshold(n, seed):
    """Pairs of texts of similarity 0.70 to 0.72, by edits of single characters."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        a = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12, 30)))
        b = list(a)
        while similarity(a, "".join(b)) > 0.72:
            b[rng.randrange(len(b))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        if similarity(a, "".join(b)) >= 0.70:
            out.append((a, "".join(b)))
    return out


def test_bit_bound_keeps_pairs_at_the_threshold():
    pairs = at_the_threshold(2000, 7)
    for words, most in MAX_BITS.items():
        a, b = (bit_sketch([p[i] for p in pairs], words) for i in (0, 1))
        assert (np.bitwise_count(a ^ b).sum(axis=1) > most).sum() <= 0.001 * len(pairs)


def test_masks_and_suffixes_keep_pairs_at_the_threshold():
    pairs = at_the_threshold(2000, 8)
    a, b = ([p[i] for p in pairs] for i in (0, 1))
    (_, x), (_, y) = p1.mask_keys(a), p1.mask_keys(b)
    assert (x.reshape(-1, len(a)) == y.reshape(-1, len(a))).any(axis=0).mean() >= 0.985
    shared = 0
    (i, x), (j, y) = p4.suffix_keys(a), p4.suffix_keys(b)
    for n in range(len(a)):
        shared += bool(set(x[i == n].tolist()) & set(y[j == n].tolist()))
    assert shared >= 0.98 * len(a)


def test_no_shared_span_is_missed():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    least = p4.PREFIX + p4.STRETCH - 1
    for n in (40, 300, 3000):
        span = text(least)
        a, b = text(n) + span + text(n), text(2 * n) + span + text(7)
        (i, x), (j, y) = p4.suffix_keys([a, "q" * 60]), p4.suffix_keys([b])
        assert set(x[i == 0].tolist()) & set(y.tolist()) and len(set(x[i == 1].tolist())) == 1


def test_packed_entries_come_back():
    rng = np.random.default_rng(1)
    e = np.zeros(1000, meeting.entry(2))
    e["key"] = np.sort(rng.integers(0, 1 << meeting.KEY_BITS, 1000, dtype=np.uint64))
    e["id"] = (5 << 40) + rng.integers(0, 1 << 16, 1000)
    e["bits"], e["tag"] = rng.integers(0, 1 << 63, (1000, 2)), rng.integers(0, 4, 1000)
    assert (meeting.unpack(meeting.pack(e, 5 << 40)) == e).all()
    assert len(meeting.unpack(meeting.pack(e[:0], 0))) == 0


@pytest.mark.parametrize("rule", [meeting.ANY, meeting.SAME, meeting.CROSS])
def test_runs_and_cells_give_all_near_pairs(rule):
    rng = np.random.default_rng(2)
    e = np.zeros(900, meeting.entry(2))
    e["key"] = np.repeat([1, 2, 3, 4], [2, 40, 200, 658])
    e["id"] = rng.integers(0, 500, 900)
    e["bits"][:, 1], e["tag"] = rng.integers(0, 1 << 12, 900), rng.integers(1, 4, 900)
    e["tag"] = e["tag"][e["id"]]  # an id has one tag
    e["bits"] = e["bits"][e["id"]]
    want = set()
    for i in range(900):
        for j in range(i):
            p, q = e[i], e[j]
            fits = {"any": True, "same": p["tag"] == q["tag"], "cross": bool(p["tag"] & 1 and q["tag"] & 2 or p["tag"] & 2 and q["tag"] & 1)}[rule]
            if p["key"] == q["key"] and p["id"] != q["id"] and fits and (int(p["bits"][1]) ^ int(q["bits"][1])).bit_count() <= 4:
                want.add((min(int(p["id"]), int(q["id"])), max(int(p["id"]), int(q["id"]))))
    pairs, cells = meeting.met_in_bucket(rng.permutation(e), 4, rule, hot=300, block=100)
    got = set(map(tuple, pairs.tolist()))
    n = 0
    for a, b in cells:
        n += 1
        got |= set(map(tuple, meeting._pairs(meeting._blocks(a, b, 4, rule)).tolist()))
    assert got == want and n > 10


def test_a_phrase_in_all_rows_ends_in_seconds(spark):
    rng = random.Random(10)
    phrase = "this recording is for training only and must not be shared "
    n = 50_000
    data = [(f"a{i:05d}", "P", "train" if i % 3 else "dev", phrase + " ".join(rng.choice(WORDS) for _ in range(14))) for i in range(n)]
    data.append(("b", "P", "dev", data[1][3] + " again"))
    df = spark.createDataFrame(data, "atom_id string, participant_source_id string, split string, visible_text string")
    began = time.time()
    assert {tuple(r) for r in p4.found(df).collect()} == {("a00001", "b", "dev")}
    assert time.time() - began < 60


def test_slices_are_bounded():
    texts = pa.array(["x" * n for n in (5, 5, 5, 100, 1, 1, 1, 1)] + [None, "é" * 9])
    got = list(slices(texts, 3, 12))
    assert [a for a, _ in got] == [0] + [b for _, b in got[:-1]] and got[-1][1] == len(texts)
    assert got == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 10)] and list(slices(texts[:0], 3)) == []


def test_few_chance_meetings_reach_the_exact_check():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    texts = [f"the light in the {word()} kitchen was some steps from the {word()} door to the {word()} and then {word()} again" for _ in range(400)]
    words = getattr(p1, "WORDS", 2)
    bits = bit_sketch(texts, words)
    i, j = np.triu_indices(len(texts), 1)
    assert max(similarity(a, b) for a, b in zip(texts, texts[1:])) < 0.45
    assert (np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= MAX_BITS[words]).mean() < 0.05  # 0.34 with sketches of 128 bits


def test_passes_have_the_keys_of_all_families():
    texts = make(50, 12)
    _, whole = p1.mask_keys(texts)
    assert (np.concatenate([keys(texts)[1] for keys, _ in p1.mask_passes()]) == whole).all()


def test_a_common_prefix_fills_no_task_and_hides_no_pair(spark, monkeypatch):
    rng = random.Random(13)
    label = "this window of the session shows in its picture: "
    data = [(f"a{i:04d}", "P", "train" if i % 3 else "dev", label + " ".join(rng.choice(WORDS) for _ in range(9))) for i in range(2600)]
    data += [("b", "P", "dev", data[1][3] + " end"), ("c", "P", "test", data[2][3].upper())]
    longest = []

    def packed(*x, plain=meeting.packed):
        sent = plain(*x)
        entries = np.concatenate([meeting.unpack(bytes(r.entries)) for r in sent.collect()])
        longest.append(np.unique(entries["key"], return_counts=True)[1].max())
        return sent

    monkeypatch.setattr(meeting, "packed", packed)
    df = spark.createDataFrame(data, "atom_id string, participant_source_id string, split string, visible_text string")
    assert {tuple(r) for r in p4.found(df).collect()} == {("a0001", "b", "dev"), ("a0002", "c", "test")}
    assert max(longest) <= 2_000


def test_common_keys_are_those_of_many_texts(spark):
    texts = [f"{i % 3} {i}" for i in range(90)]
    keys = lambda some: (np.arange(len(some)), np.array([int(x[0]) for x in some], np.uint64))
    df = spark.createDataFrame([(x,) for x in texts + ["0 more"]], "text string").coalesce(1)
    assert meeting.common_keys(df, keys, 30).tolist() == [0] and meeting.common_keys(df, keys, 31).tolist() == []
