"""Problem 1: texts that repeat with small changes, found by covering locality-sensitive hashing.

Each distinct text gets FAMILIES independent sketches of COORDINATES minhash values over its
three-character set.  Two sketches are points of a Hamming space whose distance is the number of
coordinates that differ.  In each family the masks are the words of a binary linear code: coordinate
i carries a column m(i) of RADIUS + 1 bits, and for every non-zero v the mask of v keeps the
coordinates with <m(i), v> = 1 (mod 2).  For any RADIUS differing coordinates some v is orthogonal
to all their columns, so the mask of v keeps none of them: every pair within the radius is certain to
collide in some of the 2^(RADIUS + 1) - 1 tables of the family.

The guarantee is one on sketches, and minhash is random: at similarity s a coordinate agrees with
probability s, so a family of masks of 5, 5 and 6 of eight coordinates meets a pair with probability
2 s^5 + s^6 - 2 s^8, 0.338 at s = 0.70.  Eleven families leave 1.1 per cent of the pairs at the
threshold apart, 0.2 per cent at 0.76.  A smaller radius with more families loses fewer pairs for the
same number of tables than a larger radius, because its families are independent.

Pairs that meet in a table and whose sketches of 256 bits are too far apart for the threshold are
dropped where they meet (see meeting); the rest is checked exactly on the whole texts.  How many are
left of the chance meetings, which grow with the square of the texts, decides how far this goes:
sketches of 128 bits left more than the exact check could do in time from some gigabytes on.  The
families are compared in passes, so that the longer entries take no more room.  Exact copies
are one text all along and are joined back by id at the end.

Null, blank and short texts are in no pair.  Rows delivered again count once.  Extra columns are
ignored.  An empty table gives no pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.meeting import SAME, Keys, near_pairs, sketched, with_ids
from tidemark.llm.textsim import minhashes, mix, normal_texts, verified
from tidemark.operators.graph import connected_components
from tidemark.plans.staging import stage

THRESHOLD = 0.70
RADIUS, FAMILIES, COORDINATES = 1, 11, 8
#: The columns m(i) of the code of each family: its three masks keep 5, 5 and 6 of the eight coordinates.
COLUMNS = (1, 1, 1, 2, 2, 2, 3, 3)
#: Words of 64 bits of a sketch, and families whose tables are compared in one pass.
WORDS, AT_A_TIME = 4, 6


def masks(columns: tuple[int, ...] = COLUMNS, radius: int = RADIUS) -> list[list[int]]:
    """For each non-zero v the coordinates its mask keeps."""
    return [[i for i, m in enumerate(columns) if (m & v).bit_count() & 1] for v in range(1, 1 << (radius + 1))]


def mask_keys(texts: list[str], families: int = FAMILIES, columns: tuple[int, ...] = COLUMNS, radius: int = RADIUS, begin: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, key) for each text and table of the families, or of those from begin to end: a hash of the table and the coordinates its mask keeps."""
    n = len(columns)
    end = families if end is None else end
    sketch = minhashes(texts, families * n, begin * n, end * n).astype(np.uint64)
    keys = []
    for f in range(begin, end):
        for v, kept in enumerate(masks(columns, radius)):
            key = np.full(len(texts), f * 1000 + v + 1, np.uint64)
            with np.errstate(over="ignore"):
                for i in kept:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, (f - begin) * n + i])
            keys.append(key)
    return np.tile(np.arange(len(texts)), len(keys)), np.concatenate(keys)


def mask_passes() -> list[tuple[Keys, float]]:
    """The keys of all families, some families at a time."""
    bounds = [(b, min(b + AT_A_TIME, FAMILIES)) for b in range(0, FAMILIES, AT_A_TIME)]
    return [(partial(mask_keys, begin=b, end=e), (e - b) * len(masks())) for b, e in bounds]


def _long(atoms: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, atom_id, h, text for each field of each atom that counts."""
    long = atoms.select("atom_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("body")) for f in fields))).alias("x")).select("atom_id", "x.field", "x.body")
    return normal_texts(long, "body", ["field", "atom_id"])


def near_duplicates(atoms: DataFrame, threshold: float = THRESHOLD, fields: tuple[str, ...] = ("dense_caption", "transcript")) -> tuple[DataFrame, DataFrame]:
    """(links, members): links field, h1 < h2, similarity between different texts; members field, h, atom_id.

    Normal forms are made twice, once for the texts and once for the members: that is cheaper than to
    write all texts of all copies.
    """
    rows = _long(atoms, fields)
    # One row for each text of a field; the partial aggregate keeps copies out of the shuffle.
    texts = stage(with_ids(sketched(rows.groupBy("field", "h").agg(F.min("text").alias("text")), WORDS)), "p1-texts")
    number = F.coalesce(*(F.when(F.col("field") == f, i) for i, f in enumerate(fields)))
    met = near_pairs(texts.withColumn("tag", number.cast("int")), mask_passes(), WORDS, SAME, "p1-met")
    links = stage(verified(met, texts, threshold, ["field"]), "p1-links")
    return links, stage(rows.select("field", "h", "atom_id").distinct(), "p1-members")


def found(atoms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """field, atom_id_1, atom_id_2: all pairs of atoms whose field has at least the similarity."""
    links, members = near_duplicates(atoms, threshold)
    a = members.select("field", F.col("h").alias("h1"), F.col("atom_id").alias("x"))
    b = members.select("field", F.col("h").alias("h2"), F.col("atom_id").alias("y"))
    # A text shared by several atoms links to itself.
    shared = members.groupBy("field", "h").count().where("count > 1").select("field", F.col("h").alias("h1"), F.col("h").alias("h2"))
    pairs = links.select("field", "h1", "h2").union(shared).join(a, ["field", "h1"]).join(b, ["field", "h2"]).where("h1 <> h2 or x < y")
    return pairs.select("field", F.least("x", "y").alias("atom_id_1"), F.greatest("x", "y").alias("atom_id_2")).where("atom_id_1 <> atom_id_2").distinct()


def groups(atoms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """field, atom_id, group_id, n_links: a row for each atom whose field repeats that of another.

    group_id names the group by its smallest text; n_links counts the different texts of the field
    that the atom's text is linked to.  Copies are members, not links, so a group of copies of any
    size costs one row each.
    """
    links, members = near_duplicates(atoms, threshold)
    node = lambda h: F.concat_ws(":", F.col("field"), F.col(h).cast("string"))
    edges = stage(links.select(node("h1").alias("u"), node("h2").alias("v")), "p1-edges")
    component = connected_components(edges)
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = members.withColumn("node", node("h")).join(component, "node", "left").join(degree, "node", "left")
    named = placed.select("field", "atom_id", F.coalesce("component", "node").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    many = named.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return named.join(many, "group_id", "left_semi").select("field", "atom_id", "group_id", "n_links")
