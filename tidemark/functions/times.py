"""Time functions: subtitle clocks and the virtual clock of event logs, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"(\d{1,2}):([0-5]\d):([0-5]\d)[,.](\d{1,3})"
RANGE = rf"^\s*{CLOCK}\s*-->\s*{CLOCK}(?:\s.*)?$"
VIRTUAL = r"^D([0-9]{2}) ([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?$"


def clock_seconds(text: Column, pattern: str = RANGE, first: int = 1) -> Column:
    """Seconds of the clock in the four groups from `first`; a short fraction is padded on the right."""
    h, m, s, f = (F.regexp_extract(text, pattern, first + i) for i in range(4))
    ms = F.rpad(f, 3, "0")
    return F.when(h != "", (h.cast("int") * 3_600_000 + m.cast("int") * 60_000 + s.cast("int") * 1000 + ms.cast("int")) / 1000)


def virtual_seconds(text: Column) -> Column:
    """'Dnn HH:MM[:SS]' as seconds since the first day; null where it is no such time (hours end at 23)."""
    d, h, m, s = (F.regexp_extract(text, VIRTUAL, i) for i in range(1, 5))
    return F.when((d != "") & (d != "00"), (d.cast("long") - 1) * 86_400 + h.cast("int") * 3600 + m.cast("int") * 60 + F.coalesce(F.nullif(s, F.lit("")).cast("int"), F.lit(0)))


def virtual_text(seconds: Column) -> Column:
    """Seconds as 'Dnn HH:MM:SS'; null outside the 99 days that can be written."""
    day = F.floor(seconds / 86_400)
    rest = seconds - day * 86_400
    out = F.format_string("D%02d %02d:%02d:%02d", day + 1, F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.when((day >= 0) & (day < 99), out)


def interval_gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Distance of two intervals, 0 where they touch or overlap."""
    return F.greatest(F.lit(0.0), s1 - e2, s2 - e1)
