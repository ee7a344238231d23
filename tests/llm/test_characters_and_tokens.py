import random

import pytest
import tokenizers
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import p7_confusables as p7
from tidemark.llm import p8_encoding as p8
from tidemark.llm import p9_packing as p9
from tidemark.llm import tokenizer
from tidemark.llm.confusables import skeleton, stands_in


def test_skeletons():
    same = [("ｃａｆé", "café"), ("сup", "cup"), ("a​b­", "ab"), ("a b", "a b"), ("ﬁn", "fin"), ("Αb", "Ab"), ("k͏ey", "key"), ("Ԛ", "Q"), ("κit", "kit"), ("ſew", "few"), ("ьox", "box")]
    for a, b in same:
        assert skeleton(a) == skeleton(b), (a, b)
    different = [("cafe", "café"), ("Cup", "cup"), ("O", "0"), ("l", "1"), ("I", "l"), ("x²", "x2"), ("a b", "ab"), ("a-b", "a b"), ("①", "1")]
    for a, b in different:
        assert skeleton(a) != skeleton(b), (a, b)
    assert skeleton("") == ""


@given(st.text(max_size=40))
def test_skeleton_is_stable(text):
    assert skeleton(skeleton(text)) == skeleton(text)


def test_stands_in():
    assert stands_in(skeleton("caf"), skeleton("café"))
    assert not stands_in(skeleton("cafe"), skeleton("café")) and stands_in(skeleton("cafe"), skeleton("café cafe"))
    assert not stands_in("", "x") and not stands_in(" ", "a b")


CUE = "cue_id string, atom_id string, predicate struct<all_of:array<struct<dimension:string,operator:string,value:string,evidence:struct<field:string,span:string>>>>"


def cue(i, atom, *clauses):
    return (i, atom, {"all_of": [{"dimension": "object", "operator": "present", "value": v, "evidence": {"field": f, "span": s}} for f, s, v in clauses]})


def test_found(spark):
    rows = [
        cue("c1", "a1", ("dense_caption", "red сup", "сup"), ("dense_caption", "red cup", "cup")),
        cue("c1", "a1", ("dense_caption", "red сup", "сup"), ("dense_caption", "red cup", "cup")),
        cue("c2", "a1", ("transcript", "red сup", "CUP"), ("dense_caption", "blue", None)),
        cue("c3", "a9", ("dense_caption", "red сup", "mug")),
        cue("c4", "a2", ("dense_caption", "x", "cup")),
        cue("c5", "a1", ("dense_caption", None, "c u p"), (None, "red сup", "ｍｕｇ")),
        ("c6", "a1", None),
    ]
    cues = spark.createDataFrame(rows, CUE).selectExpr("*", "'clash' as span")
    atoms = spark.createDataFrame([("a1", "a red cup"), ("a1", "a red cup"), ("a2", None)], "atom_id string, dense_caption string")
    ref = spark.createDataFrame([("cup",), ("mug",), (None,)], "cue_value string")
    got = sorted(map(tuple, p7.found(cues, atoms, ref).collect()))
    assert got == [("c1", 0, "span"), ("c1", 0, "value"), ("c5", 1, "value")]
    assert p7.found(cues.limit(0), atoms, ref).count() == 0 and p7.found(cues, atoms.limit(0), ref.limit(0)).count() == 0
    grouped = {(r.kind, r.first_form): r.n_forms for r in p7.groups(cues, atoms).collect()}
    assert grouped["value", "cup"] == 2 and grouped["span", "red cup"] == 2 and grouped["dense_caption", "a red cup"] == 1
    assert p7.consistent(cues, atoms).where("skeleton = 'red cup'").count() == 5


TEXTS = [None, "", " ", "Hello  world's <|endoftext|> x", "ab\n\n\tc  ", "猫とｶﾅ 12345 ½", "don't I'VE they'll", "a" * 5000, "é ​﻿ 🙂👍🏽", "x²≥½ ½ﬁ \x1c\x85 ᠎ y"] + ["same text", "same text"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{tokenizer.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("chunk", [1, 40, 3_000_000])
def test_encoding_equals_the_library(spark, reference, chunk):
    rng = random.Random(chunk)
    texts = TEXTS + ["".join(rng.choice("ab cé\n猫'sX1 ") for _ in range(rng.randrange(200))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in p8.encode(df, chunk_chars=chunk).collect()}
    assert got == dict(enumerate(reference(texts)))


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in p8.decode(p8.encode(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert p8.encode(df.limit(0)).count() == 0


def test_counts(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in p9.token_counts(df).collect()} == {i: len(x) for i, x in enumerate(reference(TEXTS))}


def test_local_search_empties_bins():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 200))]
        bins = p9.pack(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= 1.1 * max(sum(sizes) / 100, sum(s > 50 for s in sizes)) + 2
    assert p9.pack([], 100) == []
    # Two containers are enough, but only after an exchange.
    assert len(p9.improve([[0, 1], [2, 3], [4]], [50, 40, 50, 40, 20], 100)) == 2


def test_containers(spark):
    rng = random.Random(2)
    texts = TEXTS + [" word" * rng.choice([3, 50, 700, 2048, 2049, 5000]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'clash' as container", "1 as piece")
    got = p9.containers(df, shard_items=25).toPandas()
    counts = {r.doc_id: r.n_tokens for r in p9.token_counts(df).collect()}
    assert got.groupby("container").n_tokens.sum().max() <= p9.CAPACITY
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in counts.items() if v}
    assert not got[got.doc_id.map(counts) <= p9.CAPACITY].duplicated("doc_id").any()
    assert not got.duplicated(["doc_id", "offset"]).any()
    assert p9.containers(df.limit(0)).count() == 0
