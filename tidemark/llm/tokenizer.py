"""Public tokenizers, read from their vocabulary files; nothing is trained and no file is copied here."""

from __future__ import annotations

import base64
import functools
import os

import regex
import tiktoken

#: Folder of the vocabulary files; a parameter of every operator that tokenizes.
FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: FIXED VALUE.  The published word pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def ranks(folder: str = FOLDER, name: str = BYTE_BPE) -> dict[bytes, int]:
    """Piece to id."""
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(folder: str = FOLDER, name: str = BYTE_BPE) -> tiktoken.Encoding:
    """The encoder; strings that look like special tokens are plain text to it."""
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(folder, name), special_tokens={})


@functools.lru_cache(maxsize=1)
def splitter() -> regex.Pattern:
    """Splits a text into the words that are encoded one by one; their concatenation is the text."""
    return regex.compile(PATTERN)


def word_ids(word: str, folder: str = FOLDER, name: str = BYTE_BPE) -> list[int]:
    """Ids of one word of splitter()."""
    rank = ranks(folder, name).get(word.encode("utf-8", "surrogatepass"))
    return [rank] if rank is not None else encoding(folder, name).encode_ordinary(word)
