"""Every core query runs; every one with an SQL twin gives the same rows."""

import random
import re
import unicodedata

import numpy as np
import pytest

from tests.oracle import connect, same
from tidemark.functions.text import evidence_form
from tidemark.plans import catalog

Q, O = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(O))
def test_same_as_sql(spark, con, data_dir, name):
    assert same(Q[name](spark, data_dir), con, O[name])


def test_what_has_no_twin():
    """Each of these has a test of its own below."""
    assert set(Q) - set(O) == {"split_allocation", "normal_forms", "evidence_spans", "projection", "clusters", "minibatch_clusters"}


def test_split_allocation_is_the_fold(spark, con, data_dir):
    got = {r.component: r.split for r in Q["split_allocation"](spark, data_dir).collect()}
    c = {r.node: r.component for r in Q["dup_components"](spark, data_dir).collect()}
    size = {}
    for (s,) in con.execute("SELECT session_id FROM (SELECT DISTINCT atom_id, session_id FROM source_video_atom)").fetchall():
        size[c["s:" + s]] = size.get(c["s:" + s], 0) + 1
    order, total, have = sorted(size), sum(size.values()), {"train": 0, "dev": 0, "test": 0}
    random.Random(20260829).shuffle(order)
    want = {}
    for k in order:
        lack = {s: total * r - have[s] for s, r in (("train", 0.70), ("dev", 0.15), ("test", 0.15))}
        want[k] = max(lack, key=lack.get) if max(lack.values()) > 0 else min(have, key=lambda s: have[s] / {"train": 0.70}.get(s, 0.15))
        have[want[k]] += size[k]
    assert got and got == {k: want[k] for k in got}


def test_normal_forms_of_every_caption(spark, con, data_dir):
    caption = {(a, "dense_caption"): t for a, t in con.execute("SELECT DISTINCT atom_id, dense_caption FROM source_video_atom WHERE dense_caption IS NOT NULL").fetchall()}
    caption |= {(a, "transcript"): t for a, t in con.execute("SELECT DISTINCT atom_id, transcript FROM source_video_atom WHERE transcript IS NOT NULL").fetchall()}
    rows = Q["normal_forms"](spark, data_dir).collect()
    assert len(rows) == len(caption)
    for r in rows:
        wide = unicodedata.normalize("NFKC", caption[r.atom_id, r.field])
        assert r.tidy == re.sub(r"\s+", " ", wide).strip() and r.folded == re.sub(r"\s+", " ", wide.casefold()).strip()
        assert r.evidence == "".join(c for c in wide.casefold() if not (c.isspace() or unicodedata.category(c)[0] == "P" or unicodedata.category(c) == "Cf"))
        assert r.has_content == any(unicodedata.category(c)[0] in "LN" for c in caption[r.atom_id, r.field])


def test_evidence_spans_stand_in_their_captions(spark, con, data_dir):
    caption = {(a, f): t for a, c, s in con.execute("SELECT DISTINCT atom_id, dense_caption, transcript FROM source_video_atom").fetchall() for f, t in (("dense_caption", c), ("transcript", s))}
    span = {(c, i): ((a, f), s) for c, a, i, s, f in con.execute("SELECT DISTINCT cue_id, atom_id, i, p.evidence.span, p.evidence.field FROM (SELECT cue_id, atom_id, unnest(range(len(predicate.all_of))) AS i, unnest(predicate.all_of) AS p FROM cue_v2) WHERE p.evidence.field IN ('dense_caption', 'transcript')").fetchall()}
    rows = Q["evidence_spans"](spark, data_dir).collect()
    assert len(rows) == len(span) and any(r.slice is None for r in rows) and any(r.slice for r in rows)
    for r in rows:
        atom, wanted = span[r.cue_id, r.clause_index]
        text = caption[atom] or ""
        if r.slice is None:
            assert not evidence_form(wanted or "") or evidence_form(wanted) not in evidence_form(text) or "".join(map(evidence_form, text)) != evidence_form(text)
        else:
            assert r.slice in text and evidence_form(r.slice) == evidence_form(wanted)


def test_projection_keeps_nearness(spark, con, data_dir):
    before = {k: np.array(v) for k, v in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    after = {r.vec_id: np.array(r.embedding) for r in Q["projection"](spark, data_dir).collect()}
    assert set(after) == set(before) and all(len(v) == 16 and abs(np.linalg.norm(v) - 1) < 1e-5 for v in after.values())
    x, y = (np.stack([t[k] for k in sorted(t)]) for t in (before, after))
    upper = np.triu_indices(len(x), 1)
    assert np.corrcoef((x @ x.T)[upper], (y @ y.T)[upper])[0, 1] > 0.3


@pytest.mark.parametrize("name", ["clusters", "minibatch_clusters"])
def test_rows_are_in_the_cluster_that_is_near(spark, data_dir, name):
    source = "embeddings" if name == "clusters" else "projection"
    rows = spark.read.parquet(f"{data_dir}/embeddings.parquet") if source == "embeddings" else Q["projection"](spark, data_dir)
    v = {r.vec_id: np.array(r.embedding) for r in rows.collect()}
    got = {r.vec_id: r.cluster for r in Q[name](spark, data_dir).collect()}
    assert set(got) == set(v) and set(got.values()) <= set(range(10))
    mean = {c: np.mean([v[k] for k in v if got[k] == c], axis=0) for c in set(got.values())}
    near = sum(min(mean, key=lambda c: ((v[k] - mean[c]) ** 2).sum()) == got[k] for k in v)
    assert len(mean) > 5 and near > 0.8 * len(v)


def test_entry(spark, data_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_streams_equal_batch(spark, data_dir):
    a, b = (Q[n](spark, data_dir).collect() for n in ("state_machine", "stream_state_machine"))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
