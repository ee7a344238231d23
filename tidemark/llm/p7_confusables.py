"""Problem 7: text that looks the same but differs in its characters, by confusables skeletons.

A skeleton (see confusables) is worked out in Arrow batches, once for each row that needs one: spans
that already stand in their caption character for character are settled in the JVM and never reach
Python.  Null texts give null skeletons, empty ones empty skeletons.  Rows delivered again count
once; a cue whose atom is missing gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.confusables import skeleton, stands_in

#: cue_value_ref is a list kept by hand; beyond so many rows it is joined instead of broadcast.
REF_LIMIT = 100_000


def skeletons(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with <column>_skeleton beside each of the string columns."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{c}_skeleton", T.StringType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [pa.array([None if x is None else skeleton(x) for x in batch.column(names.index(c)).to_pylist()], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _clauses(cues: DataFrame) -> DataFrame:
    """cue_id, atom_id, clause_index, field, span, value for each clause."""
    return (
        cues.where("predicate is not null")
        .select("cue_id", "atom_id", F.posexplode("predicate.all_of").alias("clause_index", "c"))
        .select("cue_id", "atom_id", "clause_index", F.col("c.evidence.field").alias("field"), F.col("c.evidence.span").alias("span"), F.col("c.value").alias("value"))
    )


def found(cues: DataFrame, atoms: DataFrame, reference: DataFrame) -> DataFrame:
    """cue_id, clause_index, field: spans and values that only look like what they should be."""
    clauses = _clauses(cues)
    spans = clauses.where("field = 'dense_caption' and span is not null").select("cue_id", "atom_id", "clause_index", "span")
    doubtful = spans.join(atoms.select("atom_id", "dense_caption").where("dense_caption is not null"), "atom_id").where(~F.contains("dense_caption", "span")).select("cue_id", "clause_index", "span", "dense_caption")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, span, caption = (c.to_pylist() for c in batch.columns)
            good = [stands_in(skeleton(s), skeleton(c)) for s, c in zip(span, caption)]
            yield batch.select(["cue_id", "clause_index"]).filter(pa.array(good, pa.bool_()))

    in_look = doubtful.mapInArrow(look, "cue_id string, clause_index int").withColumn("field", F.lit("span"))

    known = reference.select("cue_value").where("cue_value is not null").distinct()
    bounded = known.limit(REF_LIMIT + 1).count() <= REF_LIMIT
    small = F.broadcast if bounded else (lambda x: x)
    values = clauses.where("value is not null").select("cue_id", "clause_index", "value")
    other = values.join(small(known), F.col("value") == F.col("cue_value"), "left_anti")
    forms = skeletons(known, ["cue_value"]).select("cue_value_skeleton").distinct()
    alike = skeletons(other, ["value"]).join(small(forms), F.col("value_skeleton") == F.col("cue_value_skeleton"), "left_semi")
    return in_look.union(alike.select("cue_id", "clause_index", F.lit("value").alias("field"))).distinct()


def _texts(cues: DataFrame, atoms: DataFrame) -> DataFrame:
    """kind, key, clause_index, text of every span, value and caption."""
    clauses = _clauses(cues).distinct()
    return (
        clauses.select(F.lit("span").alias("kind"), F.col("cue_id").alias("key"), "clause_index", F.col("span").alias("text"))
        .union(clauses.select(F.lit("value"), "cue_id", "clause_index", "value"))
        .union(atoms.select(F.lit("dense_caption"), "atom_id", F.lit(0), "dense_caption").distinct())
        .where("text is not null")
    )


def consistent(cues: DataFrame, atoms: DataFrame) -> DataFrame:
    """kind, key, clause_index, skeleton: every span, value and caption in its consistent form."""
    return skeletons(_texts(cues, atoms), ["text"]).select("kind", "key", "clause_index", F.col("text_skeleton").alias("skeleton"))


def groups(cues: DataFrame, atoms: DataFrame) -> DataFrame:
    """kind, skeleton, n_forms, n_texts, first_form: spans, values and captions that look the same, grouped by their skeleton.

    Each distinct text is one row before it meets its group; only counts and the smallest form are kept.
    """
    forms = _texts(cues, atoms).groupBy("kind", "text").agg(F.count("*").alias("n"))
    return skeletons(forms, ["text"]).groupBy("kind", F.col("text_skeleton").alias("skeleton")).agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_texts"), F.min("text").alias("first_form"))
