"""Grammar of a transcript: time marks, sound notes, speaker labels, hesitation sounds, speech.

A transcript is read from left to right into runs of speech by one speaker.  Marks, notes and labels
come in many habits; what they have in common is stated here once, as patterns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

#: A name as it is written in a label: one word (with a full stop where it is cut short), a word after
#: "guest" or "unidentified", or a speaker number.  Names of several words come from the roster.
NAME = r"(?:(?:guest|unidentified)\s+)?[^\W\d_]+\.?|sp(?:ea)?k(?:er)?\s?[_\s-]?\s?\d+"


def token_pattern(names: Iterable[str] = ()) -> re.Pattern:
    """What a transcript is read by; names: those of several words, which are labels as a whole."""
    own = "|".join(r"\s+".join(map(re.escape, n.split())) for n in sorted(names, key=lambda n: (-len(n), n)))
    return re.compile(
        rf"""
      <v\s+(?P<voice>[^<>\n]+)>
    | (?P<note>\[[^\[\]\n]*\] | <[^<>\n]*> | \(\([^()\n]*\)\) | \([^()\n]*\) | \{{[^{{}}\n]*\}} | \*[^*\n]+\* | ♪[^♪\n]*♪)
    | (?P<mark>(?<![\d:])\d{{1,2}}:\d\d:\d\d(?:[.,]\d{{1,3}})?(?![\d:])(?:\s*-->\s*\d{{1,2}}:\d\d:\d\d(?:[.,]\d{{1,3}})?)?)
    | (?P<arrow>>>+)
    | (?<![^\s>\])}}*♪])(?P<label>{own + "|" if own else ""}{NAME})(?:\s*\([^()\n]*\))?(?:\s*(?P<colon>[:：])(?!\d)|\s+(?P<dash>[-–—])(?=\s)|(?P<line>[ \t]*(?=\n)))
    """,
        re.VERBOSE | re.IGNORECASE,
    )


CLOCK = re.compile(r"(?:(\d{1,3}):)?(\d{1,3}):(\d\d)(?:[.,](\d{1,3}))?|(\d+(?:\.\d+)?)\s*s")
#: What may stand between a sentence and a label that has no colon.
OPEN_END = re.compile(r"[.?!…:;,]\s*$|^\s*$|\n\s*$")


def seconds(text: str) -> float | None:
    """The time that a mark names, if it is one."""
    m = CLOCK.fullmatch(text.split("-->")[0].strip())
    if not m:
        return None
    if m[5]:
        return float(m[5])
    return int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]) + (int(m[4].ljust(3, "0")) / 1000 if m[4] else 0.0)


def _plain(name: str) -> str:
    """A name without regard to case, kinds of white space and the way its accents are written."""
    return " ".join(unicodedata.normalize("NFC", name).casefold().split())


class Roster:
    """Names to speakers, in whatever spelling: case, aliases, numbers, cut short, one slip of the keys.

    rows: (speaker_id, display_name, participant_source_id, aliases).  A spelling that would fit two
    speakers names neither.
    """

    def __init__(self, rows: Iterable[tuple[str, str | None, str | None, list[str] | None]]):
        self.own: dict[str, str] = {}
        self.exact: dict[str, str] = {}
        self.number: dict[int, str] = {}
        long: set[str] = set()
        slips: dict[str, set[str]] = {}
        cuts: dict[str, set[str]] = {}
        for speaker, name, participant, aliases in sorted(rows, key=lambda r: r[0]):
            if participant:
                self.own.setdefault(participant, speaker)
            for form in [name, *(aliases or [])]:
                if not form or not form.strip():
                    continue
                form = _plain(form)
                if n := re.fullmatch(r"sp(?:ea)?k(?:er)?[\s_-]*(\d+)", form):
                    self.number.setdefault(int(n[1]), speaker)
                    continue
                self.exact.setdefault(form, speaker)
                if " " in form and not form.startswith(("guest ", "unidentified ")):
                    long.add(form)
            if name:
                low = _plain(name)
                for n in range(2, len(low)):
                    cuts.setdefault(low[:n], set()).add(speaker)
                if len(low) >= 4:
                    for slip in self._slips(low):
                        slips.setdefault(slip, set()).add(speaker)
        self.pattern = token_pattern(long)
        self.cut = {k: next(iter(v)) for k, v in cuts.items() if len(v) == 1}
        self.slip = {k: next(iter(v)) for k, v in slips.items() if len(v) == 1 and k not in self.exact}

    @staticmethod
    def _slips(name: str) -> set[str]:
        """Two neighbours exchanged, a letter doubled or a letter left out."""
        n = len(name)
        out = {name[:i] + name[i + 1] + name[i] + name[i + 2 :] for i in range(n - 1)}
        out |= {name[: i + 1] + name[i:] for i in range(n)}
        out |= {name[:i] + name[i + 1 :] for i in range(1, n)}
        return out - {name}

    def speaker(self, label: str) -> str | None:
        """The speaker that a label names, or None where it names none of the roster."""
        form = _plain(label)
        if (s := self.exact.get(form)) or (s := self.slip.get(form)):
            return s
        if n := re.fullmatch(r"sp(?:ea)?k(?:er)?[\s_-]*(\d+)", form):
            return self.number.get(int(n[1]))
        if form.endswith("."):
            return self.exact.get(form[:-1]) or self.cut.get(form[:-1])
        for lead in ("guest ", "unidentified "):
            if form.startswith(lead):
                return self.speaker(form[len(lead) :])
        return None


class Fillers:
    """Hesitation sounds: as listed, drawn out, in capitals, with punctuation."""

    def __init__(self, items: Iterable[str]):
        forms = ["".join(re.escape(m[1]) + f"{{{len(m[0])},}}" for m in re.finditer(r"(.)\1*", x.casefold().strip())) for x in items if x and x.strip()]
        self.pattern = re.compile("|".join(forms) or r"(?!)")

    def is_filler(self, piece: str) -> bool:
        core = piece.casefold().strip("".join({c for c in piece if not c.isalnum()}))
        return bool(self.pattern.fullmatch(core))


@dataclass
class Run:
    """A stretch of speech; speaker None is the atom's own participant; at is the mark before it."""

    speaker: str | None
    pieces: list[str]
    at: float | None


def runs(text: str, roster: Roster, fillers: Fillers) -> tuple[list[Run], list[float]]:
    """The runs of speech of a transcript, in order, without empty ones; and its time marks."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    out: list[Run] = []
    marks: list[float] = []
    speaker: str | None = None
    at: float | None = None

    def say(part: str) -> None:
        words = [p for p in part.split() if any(c.isalnum() for c in p) and not fillers.is_filler(p)]
        if words:
            if out and out[-1].speaker == speaker:
                out[-1].pieces.extend(words)
            else:
                out.append(Run(speaker, words, at))

    done = 0
    pos = 0
    while m := roster.pattern.search(text, pos):
        named, when = None, None
        end = m.end()
        if m["voice"] is not None:
            named = roster.speaker(m["voice"])
        elif m["note"] is not None:
            inside = m["note"][1:-1]
            when = seconds(inside)
            if when is None and m["note"][0] == "[":
                named = roster.speaker(inside)
        elif m["mark"] is not None:
            when = seconds(m["mark"])
        elif m["label"] is not None:
            named = roster.speaker(m["label"])
            before = text[done : m.start()]
            alone = m["line"] is not None and not before.rpartition("\n")[2].strip(" \t>")
            start = m["dash"] is not None and (OPEN_END.search(before) or not any(not fillers.is_filler(p) for p in before.rpartition("\n")[2].split()))
            if named is None or not (m["colon"] or alone or start):
                pos = m.start("label") + len(m["label"].split()[0])  # plain words
                continue
        say(text[done : m.start()])
        if named is not None:
            speaker = named
        if when is not None:
            at = when
            marks.append(when)
        done = pos = max(end, m.start() + 1)
    say(text[done:])
    return out, marks


def isotonic(values: list[float]) -> list[float]:
    """The nearest non-decreasing sequence in the mean square (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v in values:
        blocks.append([v, 1.0])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, w = blocks.pop()
            a, u = blocks.pop()
            blocks.append([(a * u + b * w) / (u + w), u + w])
    return [b for b, w in blocks for _ in range(int(w))]


def repaired_segments(marks: list[float], start: float, end: float) -> list[tuple[int, float]]:
    """(file segment, repaired time) of the marks of a window; see repaired()."""
    out, segment = [], 0
    for i, (m, t) in enumerate(zip(marks, repaired(marks, start, end))):
        if i and m < marks[i - 1] - (end - start) - 1:
            segment += 1
        out.append((segment, t))
    return out


def repaired(marks: list[float], start: float, end: float) -> list[float]:
    """Times of the marks inside start..end: resets of the clock undone, inconsistent marks pooled.

    A fall of the clock by more than the length of the window and a second begins a new file segment;
    in each segment the marks count from the session or, where that lies outside the window, from the
    window's start.  Each segment is made non-decreasing by isotonic regression and no segment begins
    before the one before ended.
    """
    segments: list[list[float]] = []
    for m in marks:
        if not segments or m < segments[-1][-1] - (end - start) - 1:
            segments.append([])
        segments[-1].append(m)
    out: list[float] = []
    for segment in segments:
        inside = start - 1 <= segment[0] <= end + 1
        shifted = segment if inside else [start + m - segment[0] for m in segment]
        floor = out[-1] if out else start
        out.extend(min(max(x, floor), max(end, floor)) for x in isotonic(shifted))
    return out
