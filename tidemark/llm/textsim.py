"""Text similarity shared by the near-duplicate operators: normal form, ids, exact check of pairs.

Similarity of two texts: NFKC, case folding, each run of white space to one space, trimmed; then the
Jaccard similarity of the sets of all substrings of three characters.  Only texts of at least
MIN_CHARS characters after normalising count; null and blank texts never do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import spread

MIN_CHARS = 60
#: Characters that are worked on at a time, so that long texts do not fill the memory of a task.
CHARS = 4_000_000
#: Bits that may differ, by the words of 64 bits of a sketch.  At similarity 0.70 each bit differs with
#: probability 0.15: of 128 bits 19.2 are expected with a deviation of 4.0, of 256 bits 38.4 with 5.7.
MAX_BITS = {2: 35, 4: 61}
#: Texts whose ids travel to every task, eight bytes each.
FEW = 1_000_000


def normal(text: str) -> str:
    """NFKC, case folding, white space runs to one space, trimmed."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def text_id(text: str) -> int:
    """A signed 64-bit id of a normalised text; equal texts have equal ids."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def slices(texts: pa.Array, rows: int, chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most so many rows and characters; a longer text is a run of its own."""
    length = np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(length.tolist()):
        if i > begin and (i - begin >= rows or held + n > chars):
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(length):
        yield begin, len(length)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other (uint64), and the start of each with the end."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return points, np.concatenate(([0], np.cumsum(lengths)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well mixed bits for each value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the three characters at each place, and where the grams of each text begin and end.

    The second is begin, end, begin, end and so on, as reduceat takes it; every other result is one of
    a text.  Each text has at least three characters.
    """
    points, at = codes(texts)
    with np.errstate(over="ignore"):
        gram = mix((points[:-2] * np.uint64(0x1F123BB5) + points[1:-1]) * np.uint64(0x5851F42D) + points[2:] + np.uint64(1))
    return gram, np.stack([at[:-1], at[1:] - 2], axis=1).ravel()[:-1]


def multipliers(n: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """n odd factors and n summands of a family of hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, n, dtype=np.uint64)


def minhashes(texts: list[str], n: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """n minhash values (uint32) of the three-character set of each text, or those from begin to end."""
    gram, edges = gram_codes(texts)
    gram = (gram >> np.uint64(32)).astype(np.uint32)
    odd, plus = (x.astype(np.uint32)[begin:end] for x in multipliers(n))
    out = np.empty((len(odd), len(texts)), np.uint32)
    for c in range(len(odd)):
        h = gram * (odd[c] | np.uint32(1))
        h ^= plus[c]
        out[c] = np.minimum.reduceat(h, edges)[::2]
    return out.T


def bit_sketch(texts: list[str], words: int = 2) -> np.ndarray:
    """64 one-bit minhashes of each text for each word (uint64), 32 by each of two permutations.

    Five bits of a gram's hash are its bin, the rest competes for the minimum of the bin, and one bit
    of the minimum is kept.
    """
    gram, edges = gram_codes(texts)
    n = len(texts)
    sizes = np.diff(np.append(edges, len(gram)))
    of = np.repeat(np.arange(n) * 32, sizes[::2])
    inside = np.ones(len(gram), bool)
    inside[(edges[1::2, None] + np.arange(2)).ravel()] = False
    gram = gram[inside]
    out = np.zeros((n, words), np.uint64)
    for part, (odd, plus) in enumerate(zip(*multipliers(2 * words, 77))):
        with np.errstate(over="ignore"):
            h = mix(gram * odd + plus)
        low = np.full(n * 32, 0xFFFFFFFF, np.uint32)
        np.minimum.at(low, of + (h & np.uint64(31)).astype(np.int64), (h >> np.uint64(6)).astype(np.uint32))
        low = low.reshape(-1, 32)
        for step in (1, 2, 4, 8, 16):  # an empty bin borrows from a neighbour
            empty = low == 0xFFFFFFFF
            if not empty.any():
                break
            low = np.where(empty, np.roll(low, -step, axis=1), low)
        bits = ((low * np.uint32(2654435761)) >> np.uint32(31)).astype(np.uint64)
        shifts = np.arange(32, dtype=np.uint64) + np.uint64(32 * (part % 2))
        out[:, part // 2] |= (bits << shifts).sum(axis=1, dtype=np.uint64)
    return out


def grams(text: str) -> set[str]:
    """The set of all substrings of three characters."""
    return {text[i : i + 3] for i in range(len(text) - 2)}


def set_similarity(x: set[str], y: set[str], least: float = 0.0) -> float:
    """Jaccard similarity of two sets; two empty ones count as equal.  0 where the sizes alone keep it below `least`."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the three-character sets."""
    return set_similarity(grams(a), grams(b))


def normal_texts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, h (id), text (normal form) for rows of df whose text is long enough.

    Rows with a null, blank or short text give no row.
    """
    kept = df.select(*keep, F.col(text).alias("text")).where(F.length("text") >= MIN_CHARS // 18)  # NFKC makes at most 18 characters of one
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema) + ", h bigint, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [normal(t) for t in batch.column(len(keep)).to_pylist()]
            at = [i for i, t in enumerate(out) if len(t) >= MIN_CHARS]
            if not at:
                continue
            texts = [out[i] for i in at]
            left = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [left.column(i) for i in range(len(keep))] + [pa.array([text_id(t) for t in texts], pa.int64()), pa.array(texts, pa.string())],
                names=[*keep, "h", "text"],
            )

    return spread(kept).mapInArrow(run, ddl)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, keep: list[str] | None = None) -> DataFrame:
    """h1 < h2, similarity (and keep) of the pairs (id1, id2) whose texts have at least the similarity.

    texts: id, h, text and the columns to keep from the first text, one row for each id; pairs and
    texts are staged.  Only texts that are in a pair travel, each once for each pair it is in.
    """
    keep = keep or []
    wanted = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    few = pairs.limit(FEW // 2 + 1).count() <= FEW // 2
    some = texts.select("id", "h", "text", *keep).join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    a = some.select(F.col("id").alias("id1"), F.col("h").alias("ha"), F.col("text").alias("t1"), *keep)
    b = some.select(F.col("id").alias("id2"), F.col("h").alias("hb"), F.col("text").alias("t2"))
    both = pairs.select("id1", "id2").join(a, "id1").join(b, "id2").select(*keep, F.least("ha", "hb").alias("h1"), F.greatest("ha", "hb").alias("h2"), "t1", "t2")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            known: dict[str, set[str]] = {}  # a text is in several pairs
            sets = [[known[t] if t in known else known.setdefault(t, grams(t)) for t in x.column(n + i).to_pylist()] for i in (2, 3)]
            s = np.fromiter((set_similarity(a, b, threshold) for a, b in zip(*sets)), float, x.num_rows)
            ok = pa.array(np.flatnonzero(s >= threshold))
            yield pa.RecordBatch.from_arrays([*(x.column(i).take(ok) for i in range(n + 2)), pa.array(s[s >= threshold])], names=[*keep, "h1", "h2", "similarity"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in both.select(*keep).schema) if keep else ""
    return both.mapInArrow(run, kept + "h1 bigint, h2 bigint, similarity double")
