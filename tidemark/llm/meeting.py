"""Texts that meet under a key: packed entries, buckets of keys, comparison of bit sketches.

Problems 1 and 4 give each text many keys (covering masks; windows of a sparse suffix array) and need
the pairs of texts that share a key and whose sketches allow the similarity.  An entry is (key, text,
sketch, tag); the sketch is 128 or 256 one-bit minhashes of the text, made once a text, the tag says
which side of a split it is on.  Entries travel packed, some six bytes and the sketch each: a unit of texts sends one row of arrays to each
bucket of keys instead of one row for each entry.

A bucket is a range of key hashes of about BUCKET entries.  It is sorted by key, runs of equal keys are
compared by whole arrays, and only pairs whose sketches are near leave the task.  A run of more than
HOT texts (a phrase that a third of all rows carries) is not compared where it is found: it leaves as
cells, a block of the run against another one, which are dealt out to all tasks.  No run is cut, no
partner is dropped, and no task holds more than one bucket or one cell.

The keys may come in several passes, each of which is compared before the next one is sent, so that the
shuffle files of one pass at a time are on disk.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textsim import MAX_BITS, bit_sketch, mix, slices
from tidemark.plans.staging import forget, release, stage

#: Texts that are packed together, texts that are hashed at a time, and entries of a bucket.
UNIT, AT_ONCE, BUCKET = 20_000, 2_000, 500_000
#: Texts of a unit from which it reports a key as a common one.
FEW_HERE = 8
#: Shuffle partitions at most; each takes its buckets one after the other.
PARTS = 20_000
#: Members up to which runs are compared all at once, one distance after the other.
SHORT = 32
#: Members from which a run is compared in cells, and the members of a block of a cell.
HOT, BLOCK = 16_384, 8_192
#: Cells that one task compares.
CELLS = 8
#: Bits of a key that are compared, and bytes of a difference of sorted keys that are sent as they are.
KEY_BITS, RAW = 40, 2
#: Pairs that one comparison of arrays makes: its arrays stay in a core's cache.
STRIP = 1 << 17

#: Which pairs are asked for: all, those of equal tags, those of a tag with bit 1 and one with bit 2.
ANY, SAME, CROSS = "any", "same", "cross"
#: (index of the text, key) of all keys of some texts.
Keys = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def entry(words: int) -> np.dtype:
    """An entry whose sketch has so many words."""
    return np.dtype([("key", "<u8"), ("id", "<i8"), ("tag", "u1"), ("bits", "<u8", (words,))])


def with_ids(df: DataFrame) -> DataFrame:
    """df with the column id: unique, counted on in each partition; stage the result, it is not repeatable."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=[*names, "id"])
            at += batch.num_rows

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", id bigint")


def sketched(texts: DataFrame, words: int = 2) -> DataFrame:
    """texts (whose last column is text) with the column bits: the sketch of each text, as bytes."""
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(whole.column(len(names) - 1), AT_ONCE):
                batch = whole.slice(i, j - i)
                bits = bit_sketch(batch.column(len(names) - 1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes() for row in bits], pa.binary())], names=[*names, "bits"])

    return texts.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", bits binary")


def pack(entries: np.ndarray, base: int) -> bytes:
    """Entries sorted by key: differences of the keys, ids from the base on, sketches, tags."""
    n = len(entries)
    d = np.diff(entries["key"], prepend=np.uint64(0)).view(np.uint8).reshape(n, 8)
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
    rest = squeeze.compress(np.ascontiguousarray(d[:, RAW:6].T).tobytes() + entries["tag"].tobytes()) + squeeze.flush()
    plain = [np.ascontiguousarray(d[:, :RAW]), (entries["id"] - base).astype(np.uint16), np.ascontiguousarray(entries["bits"])]
    return np.array([n, base, entries["bits"].shape[1]], np.int64).tobytes() + b"".join(x.tobytes() for x in plain) + rest


def unpack(blob: bytes) -> np.ndarray:
    n, base, words = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    out = np.empty(n, entry(words))
    at = 24
    d = np.zeros((n, 8), np.uint8)
    d[:, :RAW] = np.frombuffer(blob, np.uint8, RAW * n, at).reshape(n, RAW)
    at += RAW * n
    out["id"] = base + np.frombuffer(blob, np.uint16, n, at).astype(np.int64)
    at += 2 * n
    out["bits"] = np.frombuffer(blob, np.uint64, words * n, at).reshape(n, words)
    at += 8 * words * n
    rest = np.frombuffer(zlib.decompress(blob[at:], -15), np.uint8)
    d[:, RAW:6] = rest[: (6 - RAW) * n].reshape(6 - RAW, n).T
    out["tag"] = rest[(6 - RAW) * n :]
    out["key"] = np.cumsum(d.reshape(-1).view(np.uint64), dtype=np.uint64)
    return out


def _entries(texts: pa.Array, bits: pa.Array, ids: np.ndarray, tags: np.ndarray, keys: Keys, words: int, rule: str) -> np.ndarray:
    out = []
    for i, j in slices(texts, AT_ONCE):
        which, key = keys(texts[i:j].to_pylist())
        part = np.empty(len(which), entry(words))
        if rule == SAME:  # texts of different tags need not meet
            key = mix(key ^ mix(tags[i:j].astype(np.uint64) + np.uint64(1))[which])
        part["key"] = key >> np.uint64(64 - KEY_BITS)
        part["id"], part["tag"] = ids[i:j][which], tags[i:j][which]
        part["bits"] = np.frombuffer(b"".join(bits[i:j].to_pylist()), np.uint64).reshape(j - i, words)[which]
        out.append(part)
    return np.concatenate(out) if out else np.empty(0, entry(words))


def packed(texts: DataFrame, keys: Keys, buckets: int, words: int = 2, rule: str = ANY) -> DataFrame:
    """bucket, entries: the packed entries of texts (id, tag, text, bits), staged with the ids counting on in its files."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate(held)
        entries = entries[np.argsort(entries["key"], kind="stable")]
        bucket = (entries["key"] * np.uint64(buckets)) >> np.uint64(KEY_BITS)
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(entries)]
        base = int(entries["id"].min()) if len(entries) else 0
        rows = [(int(bucket[a]), pack(entries[a:b], base)) for a, b in zip(edges, edges[1:]) if a < b]
        for i in range(0, len(rows), 500):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[i : i + 500]], pa.int32()), pa.array([x for _, x in rows[i : i + 500]], pa.binary())], names=["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, first = [], 0, 0
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (n + b - a > UNIT or not 0 <= ids[b - 1] - first < 1 << 16 or ids[a] < first):
                    yield from send(held)
                    held, n = [], 0
                if not held:
                    first = int(ids[a])
                held.append(_entries(batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a), ids[a:b], tags[a:b], keys, words, rule))
                n += b - a
        if held:
            yield from send(held)

    return texts.select("id", "tag", "text", "bits").mapInArrow(run, "bucket int, entries binary")


Columns = tuple[np.ndarray, ...]


def _columns(e: np.ndarray) -> Columns:
    """id, tag and the words of the sketch."""
    return e["id"].copy(), e["tag"].copy(), *(e["bits"][:, i].copy() for i in range(e["bits"].shape[1]))


def _close(a: Columns, b: Columns, max_bits: int) -> np.ndarray:
    """Whether the sketches of entries a and b (arrays that broadcast) allow the similarity."""
    apart = np.bitwise_count(a[2] ^ b[2])
    kind = np.uint8 if len(a) < 6 else np.uint16  # the bits of three words are counted in a byte
    for x, y in zip(a[3:], b[3:]):
        apart = np.add(apart, np.bitwise_count(x ^ y), dtype=kind)
    return apart <= max_bits


def _asked(a: Columns, i: np.ndarray, b: Columns, j: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries i of a and j of b that are two texts whose tags allow the pair."""
    x, y, p, q = a[0][i], b[0][j], a[1][i], b[1][j]
    ok = x != y
    if rule == SAME:
        ok &= p == q
    if rule == CROSS:
        ok &= ((p & 1) & (q >> 1) | (q & 1) & (p >> 1)).astype(bool)
    return x[ok], y[ok]


def _blocks(a: np.ndarray, b: np.ndarray, max_bits: int, rule: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of two blocks, some rows at a time; of a block with itself a pair may come in both orders."""
    x, y = _columns(a), _columns(b)
    rows = max(1, STRIP // max(len(b), 1))
    for i in range(0, len(a), rows):
        j = i if a is b else 0  # what stands before has met this one
        p, q = np.nonzero(_close(tuple(c[i : i + rows, None] for c in x), tuple(c[None, j:] for c in y), max_bits))
        if len(p):
            yield _asked(x, p + i, y, q + j, rule)


def _pairs(ids: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The different pairs, smaller id first."""
    found = [np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1) for a, b in ids if len(a)]
    if not found:
        return np.empty((0, 2), np.int64)
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]


def _short_runs(e: np.ndarray, last: np.ndarray, max_bits: int, rule: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of entries sorted by key; last is the end of the run of each."""
    c = _columns(e)
    first, step = np.arange(len(e)), 1
    while len(first := first[first + step < last[first]]):
        for i in range(0, len(first), STRIP):
            a = first[i : i + STRIP]
            good = a[_close(tuple(x[a] for x in c), tuple(x[a + step] for x in c), max_bits)]
            yield _asked(c, good, c, good + step, rule)
        step += 1


def met_in_bucket(e: np.ndarray, max_bits: int, rule: str = ANY, hot: int = HOT, block: int = BLOCK) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(near pairs of the short runs, cells of the hot ones) of the entries of a bucket."""

    def sides(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One side of the split against the other; what stands on both is in both."""
        return (run[run["tag"] & 1 > 0], run[run["tag"] & 2 > 0]) if rule == CROSS else (run, run)

    e = e[np.argsort(e["key"], kind="stable")]
    edges = np.concatenate(([0], np.flatnonzero(e["key"][1:] != e["key"][:-1]) + 1, [len(e)]))
    size = np.diff(edges)
    short = size <= SHORT
    last = np.repeat(np.where(short, edges[1:], 0), size)
    pairs = [_pairs(_short_runs(e, last, max_bits, rule))]
    for i in np.flatnonzero((size > SHORT) & (size <= hot)):
        run = e[edges[i] : edges[i + 1]]
        pairs.append(_pairs(_blocks(*sides(run), max_bits, rule)))

    def cells() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in np.flatnonzero(size > hot):
            a, b = sides(e[edges[i] : edges[i + 1]])
            yield from ((a[x : x + block], b[y : y + block]) for x in range(0, len(a), block) for y in range(0 if rule == CROSS else x, len(b), block))

    return np.concatenate(pairs), cells()


def common_keys(texts: DataFrame, keys: Keys, most: int) -> np.ndarray:
    """The keys, increasing, of more than `most` texts, and those only.

    Units of texts count for themselves and report what FEW_HERE or more of their texts have, so a key
    may also stay out that has more texts, by less than FEW_HERE a unit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(held: list[np.ndarray]) -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= FEW_HERE
            return pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["key", "n"])

        held, rows = [], 0
        for batch in batches:
            for i, j in slices(batch.column(0), AT_ONCE):
                held.append(keys(batch.column(0)[i:j].to_pylist())[1])
                rows += j - i
                if rows >= UNIT:
                    yield report(held)
                    held, rows = [], 0
        if held:
            yield report(held)

    often = texts.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return np.sort(often.select("key").toArrow().column("key").to_numpy().view(np.uint64))


_MET = "id1 bigint, id2 bigint, a binary, b binary"


def _batch(pairs: np.ndarray, a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    n, m = len(pairs), len(a)
    id1, id2 = (pa.concat_arrays([pa.array(pairs[:, i]), pa.nulls(m, pa.int64())]) for i in (0, 1))
    left, right = (pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(x, pa.binary())]) for x in (a, b))
    return pa.RecordBatch.from_arrays([id1, id2, left, right], names=["id1", "id2", "a", "b"])


def near_pairs(texts: DataFrame, passes: list[tuple[Keys, float]], words: int = 2, rule: str = ANY, name: str = "met") -> DataFrame:
    """id1 < id2: pairs of texts (id, tag, text, bits; see with_ids, sketched) that share a key of a pass and whose sketches are near; staged.

    A pass is its keys and about how many of them a text has, which sizes the buckets; words is the
    length of the sketches.
    """
    n = texts.count()
    forget(texts.sparkSession)
    parts = [_met(texts, keys, int(n * per_text), words, rule, f"{name}-{i}") for i, (keys, per_text) in enumerate(passes)]
    out = stage(reduce(DataFrame.union, parts).distinct(), name)
    for part in parts:
        release(part)
    return out


def _met(texts: DataFrame, keys: Keys, entries: int, words: int, rule: str, name: str) -> DataFrame:
    """The pairs of one pass of about so many entries, staged."""
    max_bits, kind = MAX_BITS[words], entry(words)
    spark = texts.sparkSession
    buckets = max(2 * spark.sparkContext.defaultParallelism, entries // BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            pairs, cells = met_in_bucket(np.concatenate([unpack(x) for x in blobs]), max_bits, rule)
            yield _batch(pairs, [], [])
            for a, b in cells:
                yield _batch(np.empty((0, 2), np.int64), [a.tobytes()], [b.tobytes()])

        bucket, blobs = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != bucket and blobs:
                    yield from settle(blobs)
                    blobs = []
                bucket = k
                blobs.append(blob)
        if blobs:
            yield from settle(blobs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = _pairs(_blocks(np.frombuffer(a, kind), np.frombuffer(b, kind), max_bits, rule))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id1", "id2"])

    parts = min(buckets, PARTS)
    sent = packed(texts, keys, buckets, words, rule).repartitionById(parts, "bucket").sortWithinPartitions("bucket")
    met = stage(sent.mapInArrow(run, _MET), name + "-runs")
    forget(spark)
    pairs = met.where("id1 is not null").select("id1", "id2")
    if n_cells := met.where("id1 is null").count():
        cells = met.where("id1 is null").select("a", "b").repartition(-(-n_cells // CELLS))
        pairs = pairs.union(cells.mapInArrow(compare, "id1 bigint, id2 bigint"))
    out = stage(pairs.distinct(), name)
    release(met)
    return out
