import random

import pytest

from tidemark.llm import p10_subjects as p10

TERMS = {"law": ["witness", "verdict", "affidavit", "lease"], "music": ["chord", "choir", "tempo", "verse"], "sport": ["goal", "relay", "serve", "coach"]}
FRAMES = ["They asked about the {} and the {} for an hour.", "The {} was late, so the {} had to wait.", "Nobody expected the {} to need a {}."]
PLAIN = ["The kettle near the window was still warm.", "Somebody left a box of pencils open.", "We carried the lamp to the hall again."]
DECOY = ["The radio mumbled something between {} and {}."]


def document(rng, subject, share, n=10):
    out = []
    for i in range(n):
        if i < round(share * n):
            out.append(rng.choice(FRAMES).format(*rng.sample(TERMS[subject], 2)))
        elif rng.random() < 0.3:
            out.append(rng.choice(DECOY).format(*(rng.choice(TERMS[s]) for s in rng.sample(sorted(TERMS), 2))))
        else:
            out.append(rng.choice(PLAIN))
    rng.shuffle(out)
    return " ".join(out)


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        subject = rng.choice([*TERMS, None])
        share = rng.choice([0.3, 0.5, 0.8]) if subject else 0.0
        rows.append((i, document(rng, subject or "law", share), subject))
    return rows


def test_sentences():
    assert p10.sentences("## DAY1 digest\n\nOne two. Three?\nD01 07:00 | Four. \n- Five\n- Six <br/> seven!") == ["One two.", "Three?", "Four.", "Five", "Six   seven!"]
    assert len(p10.sentences("一二三。四五六？七")) == 3
    assert p10.sentences(None) == [] and p10.sentences(" \n ") == [] and p10.sentences("12 34.") == []


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(260, 1)
    docs = spark.createDataFrame([(i, t, "en" if i % 9 else None, f"kit{i % 4}", "note", None, len(t)) for i, t, _ in rows] + [(900, None, "en", "kit", "note", "P", None), (901, "", "en", "kit", "note", "P", 0), (902, "The witness. The verdict.", "en", "kit", "note", "P", 5)], "doc_id bigint, text string, lang string, source string, doc_type string, participant_source_id string, n_chars bigint")
    labels = [(i, (s or "none").upper() if i % 2 else f" {s or 'none'} ", "x") for i, _, s in rows if i % 2 == 0 or i % 5 == 0] + [(0, None, "x"), (2, "law", "y")]
    return rows, docs, spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string"), spark.createDataFrame([(i, s, "") for i, s in enumerate(TERMS)], "subject_id int, subject string, gloss string"), spark.createDataFrame([("S", "Mirela", None, None)], "speaker_id string, display_name string, participant_source_id string, aliases array<string>")


def test_held_out_accuracy(spark, tables):
    rows, *t = tables
    got = {}
    for r in p10.found(*t).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [(i, s) for i, _, s in rows if i % 2 and i % 5]
    right = sum(got.get(i, set()) == ({s} if s else set()) for i, s in held)
    assert right >= 0.93 * len(held)
    assert not got.keys() & {900, 901, 902}


def test_functions_have_the_accuracy_they_show(spark, tables):
    rows, *t = tables
    got = {(r.kind, r.key): r for r in p10.functions(*t).collect()}
    assert {k for k, _ in got} >= {"word", "pair", "source"}
    assert all(0 <= r.accuracy <= 1 and r.n_votes > 0 for r in got.values())
    # A subject's word votes for its subject, but stands in decoys too; a pair that only a decoy has votes for none.
    for subject, terms in TERMS.items():
        assert all(got["word", w].vote in (subject, "none") for w in terms)
    assert got["pair", "mumbled something"].vote == "none" and got["pair", "mumbled something"].accuracy > 0.9


def test_titles_end_no_sentence():
    assert p10.sentences("Dr. Smith came. Mrs. Jones left.") == ["Dr. Smith came.", "Mrs. Jones left."]
    assert p10.tokens("Two 2 words") == ["two", "2", "words"] and p10.words("Mirela saw 12 cats", frozenset(["mirela"])) == ["<n>", "saw", "<9>", "cats"]


def test_nothing(spark, tables):
    _, docs, labels, ref, roster = tables
    assert p10.found(docs.limit(0), labels, ref, roster).count() == 0
    assert p10.found(docs, labels.limit(0), ref, roster).count() == 0
    assert p10.composition(docs, labels, ref, roster).count() == 3
