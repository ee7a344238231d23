"""Look-alike characters: one prototype for all characters that show the same.

FIXED VALUES.  Letters of other scripts that look like a Latin letter of the same case (a subset of
the public Unicode list of confusable characters; pairs of differing case, accent or of a digit and a
letter are left out, since these differences are visible here).  Covered are Latin, Greek, Cyrillic,
Armenian, Cherokee and Hebrew letters and punctuation; letters that show as small capitals (like
Cyrillic em and te) have no lower-case Latin prototype.  Styled, wide and presentation forms are not
listed: they follow from the decompositions that unicodedata gives.
"""

from __future__ import annotations

import unicodedata

#: prototype: the characters that look like it.
LOOK_ALIKES: dict[str, str] = {
    "a": "аɑα",
    "b": "ƅьᏏ",
    "c": "сϲᴄⅽ",
    "d": "ԁᑯ",
    "e": "еҽ℮",
    "f": "ſꞙẝք",
    "g": "ɡցᶃ",
    "h": "һհ",
    "i": "іιıɩꙇ",
    "j": "јϳյ",
    "k": "κкᴋĸ",
    "l": "ӏǀ",
    "n": "ոռ",
    "o": "оοօσᴏᴑ",
    "p": "рρϱ⍴",
    "q": "ԛգզ",
    "r": "гᴦ",
    "s": "ѕꜱ",
    "u": "սυʋᴜ",
    "v": "ѵνᴠט",
    "w": "ԝѡᴡɯ",
    "x": "хҳ",
    "y": "уγүɣʏỿ",
    "z": "ᴢ",
    "A": "АΑᎪ",
    "B": "ВΒᏴ",
    "C": "СϹᏟ",
    "D": "Ꭰ",
    "E": "ЕΕᎬ",
    "F": "Ϝ",
    "G": "ԌᏀ",
    "H": "НΗᎻ",
    "I": "ІΙӀ",
    "J": "ЈͿᎫ",
    "K": "КΚKᏦ",
    "L": "Ꮮ",
    "M": "МΜϺᎷ",
    "N": "Ν",
    "O": "ОΟՕ",
    "P": "РΡᏢ",
    "Q": "Ԛ",
    "R": "Ꭱ",
    "S": "ЅՏᏚ",
    "T": "ТΤᎢ",
    "U": "Ս",
    "V": "ѴᏙ",
    "W": "ԜᎳ",
    "X": "ХΧ",
    "Y": "ҮΥУ",
    "Z": "ΖᏃ",
    "-": "‐‑‒–−˗⁃﹘",
    "'": "’‘ʼʹ′՚＇",
    '"': "“”″ʺ",
    ",": "‚٫",
    ":": "։꞉ː∶",
    ".": "․",
    "/": "⁄∕",
    "*": "∗⁎",
    "~": "∼˜",
    "!": "ǃ",
}
#: Compatibility forms that show as their decomposition; superscripts, circles, fractions and the like do not.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
#: Characters outside the category Cf that take no room.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"

PROTOTYPE = {ord(c): p for p, cs in LOOK_ALIKES.items() for c in cs}


class _Table(dict):
    """For str.translate: each character's form, worked out when it first occurs."""

    def __missing__(self, point: int) -> str | int:
        self[point] = out = _form(chr(point))
        return out


def _form(c: str) -> str:
    """What a single character (already decomposed canonically) becomes."""
    if c in PROTOTYPE_CHARS:
        return PROTOTYPE[ord(c)]
    kind = unicodedata.category(c)
    if kind == "Cf" or c in INVISIBLE or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    if kind in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85":
        return " "
    decomposition = unicodedata.decomposition(c)
    if decomposition.startswith(SAME_LOOK):
        parts = "".join(chr(int(x, 16)) for x in decomposition.split()[1:])
        if parts[:1] != " " or len(parts) == 1:  # spacing accents stay as they are
            return "".join(_form(x) for x in unicodedata.normalize("NFD", parts))
    return c


PROTOTYPE_CHARS = {chr(p) for p in PROTOTYPE}
_TABLE = _Table()


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again.

    Equal skeletons mean equal looks: width, invisible characters, the kind of a space and look-alike
    letters make no difference; case, accents and digits against letters do.
    """
    if text.isascii():
        return text.translate(_TABLE) if any(c in text for c in "\t\n\x0b\x0c\r") else text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE))


def stands_in(part: str, whole: str) -> bool:
    """Whether a skeleton stands in another, not cutting an accent off its letter; an empty one never does."""
    if not part.strip():
        return False
    at = whole.find(part)
    while at >= 0:
        end = at + len(part)
        if end == len(whole) or not unicodedata.combining(whole[end]):
            return True
        at = whole.find(part, at + 1)
    return False
