"""Problem 5: token ids of whole texts by a public byte-level BPE vocabulary.

Method: monoid tree reduction. A text is encoded in halves down to leaves; two neighbours are joined by encoding anew the
window around their seam. Before white space that follows something else a token always ends, whatever stands around, for no
alternative of the vocabulary's pattern runs from other characters into white space. So the window from the nearest such
place on one side of the seam to that on the other, or to the end of its node, holds every token that the seam can have
changed; each node carries its outermost such places, so the window is known at once and need not be grown step by step.
Decoding concatenates up the tree as well. A text of at most LEAF code points is one leaf.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the vocabulary's published pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS, STABLE = regex.compile(PATTERN), regex.compile(r"(?<=\S)\s")
LEAF = 4096
#: Words remembered by a worker; the store starts anew beyond.
REMEMBERED = 1 << 19


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Node(NamedTuple):
    """A stretch of text with its ids; outside head and tail its tokens are those of the whole text."""

    start: int
    end: int
    ids: bytes  # four each
    head: int  # where its first stable place is, or its end
    head_ids: int  # ids before that place
    tail: int  # where its last stable place is, or its start
    tail_ids: int  # ids from that place on


class Known(dict):
    """Ids of the words met so far."""

    def __init__(self, piece: Callable[[str], list[int]]):
        self.piece = piece

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = np.array(self.piece(word), "<i4").tobytes()
        return ids


class Encoder:
    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # A word taken by itself is one word again, so the library's whole encoding of it is that of the word.
        piece = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = {i: b for b, i in ranks.items()}
        self.known = Known(piece)
        self.leaf = leaf

    def words(self, text: str) -> bytes:
        """Ids of a text whose ends are ends of words."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, WORDS.findall(text)))

    def _leaf(self, text: str, start: int, end: int) -> Node:
        part = text[start:end]
        first = STABLE.search(part)
        if first is None:
            ids = self.words(part)
            return Node(start, end, ids, end, len(ids), start, len(ids))
        a = first.start()
        b = max(m.start() for m in STABLE.finditer(part, a - 1)) if a else a
        head, middle, tail = (self.words(x) for x in (part[:a], part[a:b], part[b:]))
        return Node(start, end, head + middle + tail, start + a, len(head), start + b, len(tail))

    def _join(self, text: str, left: Node, right: Node) -> Node:
        window = self.words(text[left.tail : right.head])
        before, after = left.ids[: len(left.ids) - left.tail_ids], right.ids[right.head_ids :]
        ids = before + window + after
        # The seam itself may be a stable place, but the nearest known ones serve as well.
        some_left, some_right = left.head < left.end, right.head < right.end
        head, head_ids = (left.head, left.head_ids) if some_left else (right.head, len(window)) if some_right else (right.end, len(ids))
        tail, tail_ids = (right.tail, right.tail_ids) if some_right else (left.tail, len(window)) if some_left else (left.start, len(ids))
        return Node(left.start, right.end, ids, head, head_ids, tail, tail_ids)

    def _node(self, text: str, start: int, end: int) -> Node:
        if end - start <= self.leaf:
            return self._leaf(text, start, end)
        middle = (start + end) // 2
        return self._join(text, self._node(text, start, middle), self._node(text, middle, end))

    def encode(self, text: str) -> bytes:
        return self.words(text) if len(text) <= self.leaf else self._node(text, 0, len(text)).ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    """Called in the tasks: the vocabulary is looked up where it is used."""
    if path is None:
        path = vocabulary_path()
    elif not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    return Encoder(path)


def shipped(path: str | None) -> str | None:
    """A vocabulary file of the driver's, sent to the executors; without one they take that of their own installation."""
    spark = SparkSession.getActiveSession()
    if path and spark and os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def token_ids(text: str | Column, path: str | None = None) -> Column:
    """array<int> of a text's token ids, without special tokens; an empty array for empty and for null text."""
    path = shipped(path)

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        encode = encoder(path).encode
        parts = [encode(t) if t else b"" for t in text.to_pylist()]
        ends = np.cumsum([0, *map(len, parts)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))

    return ids(text)


def token_text(ids: str | Column, path: str | None = None) -> Column:
    """The text that token ids stand for; '' for an empty list, null for null. Bytes that are no UTF-8 come as U+FFFD."""
    path = shipped(path)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        decode = encoder(path).decode
        return pa.array([None if x is None else decode(x).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return text(ids)


def encoded(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): token ids of each row's text; repeated keys stay, other columns go. No shuffle."""
    return df.select(F.col(key), token_ids(F.col(text), path).alias("ids"))
