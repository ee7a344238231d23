import random

import pytest

from tidemark.llm import p2_speaker_turns as p2
from tidemark.llm.transcript import Fillers, Roster, isotonic, repaired, runs, seconds

PEOPLE = [("SP01", "Mirela", "P01", ["Miri", "SPK_01"]), ("SP02", "Tovan", "P02", ["Tovi", "SPK_02"]), ("SP31", "Wendrik", None, ["guest Wendrik", "SPK_31"]), ("SP99", "Unknown", None, ["unidentified voice", "SPK_99"]), ("SP50", None, None, None)]
SOUNDS = ["um", "er", "hmm", "mhm", "ah"]


@pytest.fixture(scope="module")
def grammar():
    return Roster(PEOPLE), Fillers(SOUNDS)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Hello there", [(None, 2)]),
        ("MIRELA: one two. Tovna (on phone): three", [("SP01", 2), ("SP02", 1)]),
        ("[00:01:02] >> Tov.: one 12:30 two", [("SP02", 3)]),
        ("Miri - one <00:00:01.5> two\n<v SPK-31> three", [("SP01", 2), ("SP31", 1)]),
        ("Mirela\n one two\nspk 2\n three", [("SP01", 2), ("SP02", 1)]),
        ("guest wendrik: errrr, one UM… two [laughs] *clatter* ((music)) ♪ x y ♪ {sighs} (soft)", [("SP31", 2)]),
        ("Listen: the time is 9:05", [(None, 5)]),
        ("Tell Mirela that Tovan left", [(None, 5)]),
        ("00:00:01,000 --> 00:00:02,000 one ... --- two", [(None, 2)]),
        ("Mirela: um. [0:21] Tovan: two", [("SP02", 1)]),
        ("Mirela: one Miri: two", [("SP01", 2)]),
        ("Jim: one", [(None, 2)]),
        ("hummm mmm her", [(None, 3)]),
        ("", []),
        ("[laughs] um", []),
    ],
)
def test_runs(grammar, text, want):
    assert [(r.speaker, len(r.pieces)) for r in runs(text, *grammar)[0]] == want


def test_names_of_the_roster_in_other_writing():
    people = [*PEOPLE, ("SP60", "Anna Maria", None, ["A. M."]), ("SP61", "Jos\u00e9", None, None)]
    names, sounds = Roster(people), Fillers(SOUNDS)
    who = lambda text: [(r.speaker, len(r.pieces)) for r in runs(text, names, sounds)[0]]
    assert who("Anna Maria: one two") == [("SP60", 2)] and who("ANNA  MARIA - one") == [("SP60", 1)]
    assert who("Jose\u0301: one two") == [("SP61", 2)] and who("Mirela\uff1a one two") == [("SP01", 2)]
    assert who("Anna said one: two") == [(None, 4)]


def _best_fit(values, step=0.5):
    """The non-decreasing sequence nearest in the mean square, over all sequences of some grid."""
    grid = [i * step for i in range(int(min(values) / step), int(max(values) / step) + 2)]
    best = {g: (0.0, ()) for g in grid}
    for v in values:
        new, least = {}, None
        for g in grid:
            if least is None or best[g][0] < least[0]:
                least = best[g]
            new[g] = (least[0] + (v - g) ** 2, (*least[1], g))
        best = new
    return min(best.values())


def test_marks_are_repaired_as_by_brute_force(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for n in range(30):
        start, t, stated = 100.0 * n, 100.0 * n, []
        for _ in range(rng.randrange(2, 6)):
            t += rng.randrange(1, 5)
            stated.append(t + rng.choice([0, 0, 0, -6, 6]))
        stated = [max(x, start) for x in stated]
        rows.append((f"a{n}", "s", "P01", start, start + 60, " ".join(f"[{int(x // 3600):02d}:{int(x % 3600 // 60):02d}:{int(x % 60):02d}] word" for x in stated)))
        want[f"a{n}"] = (stated, _best_fit(stated))
    rows.append(("b", "s", "P01", 0.0, 10.0, "[00:00:05] one [00:00:07] two <00:00:00> three"))
    rows.append(("c", "s", "P01", 5.0, 9.0, "no mark"))
    df = spark.createDataFrame(rows, "atom_id string, session_id string, participant_source_id string, local_start_sec double, local_end_sec double, transcript string")
    roster = spark.createDataFrame(PEOPLE, "speaker_id string, display_name string, participant_source_id string, aliases array<string>")
    got = {}
    for r in p2.marks(df, roster, spark.createDataFrame([("um",)], "filler string")).orderBy("atom_id", "mark_no").collect():
        got.setdefault(r.atom_id, []).append((r.stated_sec, r.segment_no, r.repaired_sec))
    assert "c" not in got and [x[0] for x in got["b"]] == [5.0, 7.0, 0.0]
    moved = 0
    for atom, (stated, (cost, _)) in want.items():
        assert [x[0] for x in got[atom]] == stated and {x[1] for x in got[atom]} == {0}
        out = [x[2] for x in got[atom]]
        assert out == sorted(out)
        assert sum((a - b) ** 2 for a, b in zip(stated, out)) <= cost + 1e-9  # no sequence of the grid is nearer
        moved += out != stated
    assert moved > 5


def test_marks():
    assert seconds("00:01:02,5") == 62.5 and seconds("9:05") == 545 and seconds("167.3s") == 167.3 and seconds("100:10") == 6010
    assert seconds("laughs") is None


def test_isotonic_is_the_nearest_non_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        v = [rng.uniform(0, 10) for _ in range(rng.randrange(1, 9))]
        out = isotonic(v)
        assert out == sorted(out) and abs(sum(out) - sum(v)) < 1e-9
        cost = sum((a - b) ** 2 for a, b in zip(out, v))
        for _ in range(40):
            other = sorted(x + rng.uniform(-1, 1) for x in out)
            assert cost <= sum((a - b) ** 2 for a, b in zip(other, v)) + 1e-9
    assert isotonic([]) == []


def test_clock_resets():
    assert repaired([101, 103, 102, 104], 100, 110) == [101, 102.5, 102.5, 104]
    assert repaired([105, 1, 4], 100, 110) == [105, 105, 105]  # a second file segment, from the window's start on
    assert repaired([], 0, 1) == []


def test_turns(spark):
    schema = "atom_id string, session_id string, participant_source_id string, local_start_sec double, local_end_sec double, transcript string, text string"
    atoms = [
        ("a1", "s", "P01", 0.0, 2.0, "one two", "clash"),
        ("a2", "s", "P01", 899.0, 902.0, "Mirela: three Tovan: four", None),
        ("a3", "s", "P01", 900.5, 903.0, "tovan: five [laughs]", None),
        ("a3", "s", "P01", 900.5, 903.0, "tovan: five [laughs]", None),
        ("a4", "s", "P01", 3000.0, 3001.0, "um", None),
        ("a5", "s", "P01", 9000.0, 9001.0, "spk_02: six", None),
        ("a6", "s", "P09", 9100.0, 9101.0, "seven", None),
        ("a7", "t", "P01", None, 1.0, "lost", None),
        ("a8", None, "P01", 0.0, 1.0, "lost", None),
        ("a9", "t", "P01", 1.0, 2.0, None, None),
        ("b1", "t", "P01", 1.0, 2.0, "  ", None),
        ("b2", "t", "P01", 1.0, None, "tie b", None),
        ("b0", "t", "P02", 1.0, None, "tie a", None),
    ]
    df = spark.createDataFrame(atoms, schema)
    roster = spark.createDataFrame(PEOPLE, "speaker_id string, display_name string, participant_source_id string, aliases array<string>")
    sounds = spark.createDataFrame([(s,) for s in SOUNDS] + [(None,)], "filler string")
    want = [("s", 1, "SP01", 3), ("s", 2, "SP02", 3), ("s", 3, "SP99", 1), ("t", 1, "SP02", 2), ("t", 2, "SP01", 2)]
    assert sorted(map(tuple, p2.found(df, roster, sounds).collect())) == want
    full = {(r.session_id, r.turn_no): r for r in p2.turns(df, roster, sounds).collect()}
    assert full["s", 1].start_sec == 0.0 and full["s", 2].end_sec == 9001.0
    said = p2.speech(df, roster, sounds).where("session_id = 's' and turn_no = 2").orderBy("start", "atom_id", "part").collect()
    assert " ".join(r.text for r in said) == "four five six" and {r.speaker_id for r in said} == {"SP02"}
    assert p2.speech(df.limit(0), roster, sounds).count() == 0
    assert p2.found(df.limit(0), roster, sounds).count() == 0
    assert p2.found(df, roster.limit(0), sounds.limit(0)).where("speaker_id <> 'SP99'").count() == 0
