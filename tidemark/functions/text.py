"""Text functions that Spark SQL lacks, as Arrow-batched functions, and the JVM-side ones beside them.

All take and return string columns; null gives null unless stated.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(value: str) -> str:
    """NFKC, case folding, white space runs to one space, trimmed."""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def tidy(value: str) -> str:
    """NFKC and white space runs to one space, trimmed; case is kept."""
    return " ".join(unicodedata.normalize("NFKC", value).split())


def eligible_form(value: str) -> str:
    """fold() with format characters (category Cf) removed."""
    return fold("".join(c for c in unicodedata.normalize("NFKC", value) if unicodedata.category(c) != "Cf"))


def _drops(c: str) -> bool:
    kind = unicodedata.category(c)
    return c.isspace() or kind[0] == "P" or kind == "Cf"


def evidence_form(value: str) -> str:
    """NFKC and case folding without white space, punctuation and format characters."""
    return "".join(c for c in unicodedata.normalize("NFKC", value).casefold() if not _drops(c))


def evidence_slice(source: str | None, evidence: str | None) -> str | None:
    """The contiguous slice of source whose evidence form is that of evidence, first match.

    None where there is none, where the evidence has no content, or where normalising the source
    character by character gives something else than normalising it whole.
    """
    if not source or not evidence:
        return None
    wanted, whole = evidence_form(evidence), evidence_form(source)
    parts = [evidence_form(c) for c in source]
    if not wanted or "".join(parts) != whole or (begin := whole.find(wanted)) < 0:
        return None
    # ends[i]: how much of the form the first i + 1 characters of the source make.
    ends = list(accumulate(map(len, parts)))
    return source[bisect_right(ends, begin) : bisect_right(ends, begin + len(wanted) - 1) + 1]


def ngrams(value: str, n: int = 3) -> list[str]:
    """The distinct substrings of n characters, sorted; a shorter value is its own only one; empty has none."""
    if len(value) < n:
        return [value] if value else []
    return sorted({value[i : i + n] for i in range(len(value) - n + 1)})


def canonical_json(value: str) -> str:
    """JSON with sorted keys, no spaces, characters as they are."""
    return json.dumps(json.loads(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def mapped(f: Callable[[str], object], kind: str = "string") -> Callable[[Column | str], Column]:
    """A column function from a function of one string, by Arrow batches; made when it is first used."""

    def column(c: Column | str) -> Column:
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else f(v))

        return F.pandas_udf(run, kind)(c)

    return column


nfkc_casefold = mapped(fold)
nfkc_tidy = mapped(tidy)
eligibility_form = mapped(eligible_form)
evidence_normal = mapped(evidence_form)
canonical = mapped(canonical_json)


def evidence_span(source: Column | str, evidence: Column | str) -> Column:
    """Column form of evidence_slice."""

    def run(s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([evidence_slice(a, b) for a, b in zip(s, e)], dtype="object")

    return F.pandas_udf(run, "string")(source, evidence)


def collapse(column: Column | str) -> Column:
    """White space runs (Unicode and the separators U+001C to U+001F) to one space, trimmed; in the JVM."""
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{1C}-\x{1F}]+", " "))


def lower_collapse(column: Column | str) -> Column:
    """Lower case and ASCII white space collapsed: the form that SQL twins share."""
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f\x0B]+", " "))


def char_trigrams(column: Column | str) -> Column:
    """The substrings of three characters as numbers, one for each place, in the JVM; null for null.

    A number holds the three code points, so equal numbers are equal substrings.  A shorter text is its
    own only one, as a negative number; an empty text has none.
    """
    text = F.col(column) if isinstance(column, str) else column

    def numbers(c: Column) -> Column:
        n = F.size(c)
        code = lambda i, j: F.get(c, i).cast("bigint") * (1 << j)
        few = F.when(n == 2, -1 - code(F.lit(0), 21) - code(F.lit(1), 0)).otherwise(-1 - code(F.lit(0), 0))
        return F.when(n >= 3, F.transform(F.sequence(F.lit(2), n - 1), lambda i: code(i - 2, 42) + code(i - 1, 21) + code(i, 0))).otherwise(F.array(few))

    # The code points are bound to a variable: named twice, they would be made anew for each place.
    points = F.transform(F.split(text, ""), F.ascii)
    return F.when(text == "", F.array().cast("array<bigint>")).when(text.isNotNull(), F.get(F.transform(F.array(points), numbers), 0))


def has_letter_or_digit(column: Column | str) -> Column:
    """Whether there is any letter or number."""
    return (F.col(column) if isinstance(column, str) else column).rlike(r"[\p{L}\p{N}]")


def whole_word(column: Column, word: str) -> Column:
    """An ASCII word stands between non-letters; any other marker just stands in the text."""
    if word.isascii():
        return column.rlike(rf"(?i)(?<![A-Za-z]){word}(?![A-Za-z])")
    return F.contains(column, F.lit(word))


def json_path(*parts: str | Column) -> Column:
    """A JSON path from names and, as columns, places in arrays: $.a.b[0].c."""
    out: list[Column] = [F.lit("$")]
    for p in parts:
        out += [F.lit(f".{p}")] if isinstance(p, str) else [F.lit("["), p.cast("string"), F.lit("]")]
    return F.concat(*out)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays: 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def visible_text(transcript: Column, caption: Column) -> Column:
    """Both texts under their headings, or the one that is there."""
    t, c = F.nullif(F.trim(transcript), F.lit("")), F.nullif(F.trim(caption), F.lit(""))
    return F.when(t.isNotNull() & c.isNotNull(), F.concat(F.lit("Dense caption: "), c, F.lit("\nTranscript: "), t)).otherwise(F.coalesce(c, t, F.lit("")))


def modality_coverage(transcript: Column, caption: Column) -> Column:
    """both, transcript_only, dense_caption_only or none."""
    t, c = F.coalesce(F.trim(transcript) != "", F.lit(False)), F.coalesce(F.trim(caption) != "", F.lit(False))
    return F.when(t & c, "both").when(t, "transcript_only").when(c, "dense_caption_only").otherwise("none")
