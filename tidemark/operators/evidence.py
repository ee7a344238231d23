"""Span-grounded predicates: do clauses hold in a text, and are they grounded in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import lower_collapse

#: FIXED VALUES: the operators that assert presence; all others assert absence.
PRESENCE = ("eq", "present", "starts", "ends", "contains")
#: FIXED VALUES: values that name nothing.
SENTINELS = ("null", "none", "unknown", "n/a", "na", "nil", "无", "未知")


def unsatisfied(clauses: Column, haystack: Column) -> Column:
    """Indexes of the clauses (operator, value) that do not hold in the haystack, which is in lower form.

    A presence clause holds when its value is there; any other when it is not.  An empty value is
    never there.
    """

    def fails(c: Column, i: Column) -> Column:
        value = lower_collapse(c["value"])
        there = F.coalesce((value != "") & F.contains(haystack, value), F.lit(False))
        return F.when(there != c["operator"].isin(*PRESENCE), i)

    return F.filter(F.transform(clauses, fails), lambda x: x.isNotNull())


def grounding_code(field: Column, span: Column, value: Column, transcript: Column, caption: Column) -> Column:
    """The first rule that a clause's evidence breaks, or null.

    The codes are fixed values.  CROSS_FIELD_EVIDENCE: no such field, or the span stands only in the other one.
    SPAN_NOT_CONTIGUOUS: it stands in neither.  VALUE_NOT_SUPPORTED: the value is empty, names nothing
    or is not inside the span.
    """
    own = F.when(field == "transcript", transcript).when(field == "dense_caption", caption)
    other = F.when(field == "transcript", caption).when(field == "dense_caption", transcript)
    inside = lambda text: F.coalesce((span != "") & F.contains(text, span), F.lit(False))
    v, s = F.trim(value), F.trim(span)
    supported = F.coalesce((v != "") & F.contains(s, v) & ~F.lower(v).isin(*SENTINELS), F.lit(False))
    known = F.coalesce(field.isin("transcript", "dense_caption"), F.lit(False))
    return F.when(~known, "CROSS_FIELD_EVIDENCE").when(~inside(own) & inside(other), "CROSS_FIELD_EVIDENCE").when(~inside(own), "SPAN_NOT_CONTIGUOUS").when(~supported, "VALUE_NOT_SUPPORTED")


def exploded(cues: DataFrame) -> DataFrame:
    """cue_id, atom_id, clause_index, dimension, operator, value, field, span for each clause of each cue."""
    one = cues.where("predicate is not null").select("cue_id", "atom_id", F.posexplode("predicate.all_of").alias("clause_index", "c"))
    return one.select("cue_id", "atom_id", "clause_index", "c.dimension", "c.operator", "c.value", F.col("c.evidence.field").alias("field"), F.col("c.evidence.span").alias("span")).distinct()


def domain_code(value: Column, allowed: tuple[str, ...], code: str) -> Column:
    """code where the value is not among the allowed, else null."""
    return F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), code)


def expand_compact(responses: DataFrame, key: str, body: str, codes: dict[str, str]) -> DataFrame:
    """key, n, field, span, clauses, confidence, status of each item of compact JSON answers.

    An answer is a list of objects with n (number), f (field code), x (span), p (clauses as lists of
    dimension, operator, value), c (confidence in per cent).  Items fail on their own: an unknown code
    or a missing number gives the status invalid_item, an answer that is no list invalid_json.
    """
    schema = "array<struct<n:int,f:string,x:string,p:array<array<string>>,c:int>>"
    parsed = responses.withColumn("items", F.from_json(body, schema))
    mapping = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    each = parsed.select(key, F.posexplode_outer("items").alias("pos", "i"))
    clauses = F.transform("i.p", lambda c: F.struct(F.get(c, 0).alias("dimension"), F.get(c, 1).alias("operator"), F.get(c, 2).alias("value")))
    field = F.element_at(mapping, F.col("i.f"))
    status = F.when(F.col("pos").isNull(), "invalid_json").when(F.col("i.n").isNull() | field.isNull(), "invalid_item").otherwise("ok")
    return each.select(key, F.col("i.n").alias("n"), field.alias("field"), F.col("i.x").alias("span"), clauses.alias("clauses"), (F.col("i.c") / 100).alias("confidence"), status.alias("status"))
