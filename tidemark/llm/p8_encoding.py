"""Problem 8: encoding of the whole corpus through a distinct-word table.

1. One pass splits each text into words and writes each chunk of documents (about CHUNK_CHARS
   characters) as the positions of its words in the chunk's own list of distinct words.
2. The lists of all chunks give the distinct-word table; each word in it is encoded once.
3. The ids join back to (chunk, place in the list) by word, and meet the chunk's documents, whose
   words are replaced by position.
What is shuffled are distinct words of chunks and one compressed row of positions for each chunk,
not the words of the corpus.  No table is broadcast and no group is larger than a chunk; a longer
text is a chunk of its own.

Null, empty: the empty list of ids.  Rows delivered again are encoded as often as they are there;
documents with a null doc_id keep it.  Strings that look like special tokens are plain text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokenizer
from tidemark.plans.staging import spread, stage

CHUNK_CHARS = 3_000_000


def chunked(documents: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """chunk, doc_ids, lengths, codes (one row a chunk) and chunk, place, word (a row for each distinct word of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = tokenizer.splitter().findall
        base, number = TaskContext.get().partitionId() << 32, 0
        places: dict[str, int] = {}
        ids: list[int | None] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        chars = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number, places, ids, lengths, codes, chars
            if ids:
                chunk, words = base + number, list(places)
                packer = zstandard.ZstdCompressor(level=3)
                every = np.concatenate(codes) if codes else np.empty(0, np.uint32)
                if len(words) <= 1 << 16:  # width two or four, told by the first byte
                    blob = b"2" + packer.compress(every.astype(np.uint16).tobytes())
                else:
                    blob = b"4" + packer.compress(every.astype(np.uint32).tobytes())
                yield rows([chunk], [ids], [packer.compress(np.array(lengths, np.uint32).tobytes())], [blob], [None], [None])
                for i in range(0, len(words), 10_000):
                    part = words[i : i + 10_000]
                    n = len(part)
                    yield rows([chunk] * n, [None] * n, [None] * n, [None] * n, range(i, i + n), part)
            number, places, ids, lengths, codes, chars = number + 1, {}, [], [], [], 0

        def rows(*columns) -> pa.RecordBatch:
            types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["chunk", "doc_ids", "lengths", "codes", "place", "word"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if chars and chars + len(text) > chunk_chars:
                    yield from out()
                words = split(text)
                get = places.setdefault
                codes.append(np.fromiter((get(w, len(places)) for w in words), np.uint32, len(words)))
                ids.append(doc)
                lengths.append(len(words))
                chars += len(text) + 1
        yield from out()

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, "chunk bigint, doc_ids array<bigint>, lengths binary, codes binary, place int, word string")


def word_table(words: DataFrame, folder: str = tokenizer.FOLDER, name: str = tokenizer.BYTE_BPE) -> DataFrame:
    """word, ids (two or four bytes each, as the vocabulary needs): each distinct word encoded once."""
    wide = np.uint16 if max(tokenizer.ranks(folder, name).values()) < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.array(tokenizer.word_ids(w, folder, name), wide).tobytes() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["word", "ids"])

    return words.select("word").distinct().mapInArrow(run, "word string, ids binary")


def encode(documents: DataFrame, folder: str = tokenizer.FOLDER, name: str = tokenizer.BYTE_BPE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, ids: the token ids of each document, without special tokens."""
    width = 2 if max(tokenizer.ranks(folder, name).values()) < 1 << 16 else 4
    rows = stage(chunked(documents, chunk_chars), "p8-chunks")
    words = rows.where("word is not null").select("chunk", "place", "word")
    placed = words.join(word_table(words, folder, name), "word").select(F.col("chunk").alias("of_chunk"), "place", "ids")
    chunks = rows.where("doc_ids is not null").select("chunk", "doc_ids", "lengths", "codes")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, lengths, codes = (left.column(c)[0] for c in ("doc_ids", "lengths", "codes"))
        unpack = zstandard.ZstdDecompressor().decompress
        n_words = np.frombuffer(unpack(lengths.as_py()), np.uint32).astype(np.int64)
        blob = codes.as_py()
        code = np.frombuffer(unpack(blob[1:]), np.uint16 if blob[:1] == b"2" else np.uint32).astype(np.int64)
        order = np.argsort(right.column("place").to_numpy())
        pieces = right.column("ids").to_pylist()
        every = [pieces[i] for i in order]
        size = np.fromiter(map(len, every), np.int64, len(every)) // width
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        flat = np.frombuffer(b"".join(every), np.uint16 if width == 2 else np.uint32)
        # Ragged gather: the ids of word after word.
        reps = size[code]
        ends = np.cumsum(reps)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(begin[code] - (ends - reps), reps) + np.arange(total)
        ids = flat[where].astype(np.int32)
        per_word = np.concatenate(([0], ends))
        offsets = per_word[np.concatenate(([0], np.cumsum(n_words)))].astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
        return pa.table({"doc_id": doc_ids.values, "ids": out})

    return chunks.groupBy("chunk").cogroup(placed.groupBy("of_chunk")).applyInArrow(assemble, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, folder: str = tokenizer.FOLDER, name: str = tokenizer.BYTE_BPE) -> DataFrame:
    """doc_id, text from doc_id, ids by a join with the id-to-piece table.

    The piece table has as many rows as the vocabulary and is broadcast.  A list without ids gives
    the empty text.  doc_id must be unique.
    """
    spark = encoded.sparkSession
    pieces = spark.createDataFrame([(i, bytearray(p)) for p, i in tokenizer.ranks(folder, name).items()], "id int, piece binary")
    each = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
    joined = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("p")))).alias("all"))
    text = joined.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("all", lambda x: x["p"]), "")), "UTF-8").alias("text"))
    return encoded.select("doc_id").join(text, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


#: The exact round trip: what is decoded is what was encoded; null gives the empty text.
DECODED_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
