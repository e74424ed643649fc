"""Token ids of texts by a public byte-level tokenizer."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

DEFAULT_FOLDER = "/opt/tokenizers"
# Fixed value: how byte_bpe_50k cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in each Python worker, and the longest of them in bytes.
KEPT_WORDS, KEPT_BYTES = 100_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary strings with their ids, from a file of lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(x): int(n) for x, n in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the neighbours of least rank are merged, the leftmost first, until none is in ``ranks``.

    The symbols are a doubly linked list; a queue holds the possible merges by rank. A merge makes older entries
    of its neighbours stale: they no longer spell what the list holds there and are skipped.
    """
    if len(word) == 1:
        return [ranks[word]]
    part: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after = [*range(1, len(word)), -1]
    before = [*range(-1, len(word) - 1)]
    queue = [(r, i, p) for i in range(len(word) - 1) if (r := ranks.get(p := word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, spelt = heapq.heappop(queue)
        left = part[i]
        if left is None or (j := after[i]) < 0 or left + part[j] != spelt:
            continue
        part[i], part[j] = spelt, None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get(p := spelt + part[k])) is not None:
                heapq.heappush(queue, (r, i, p))
        if (h := before[i]) >= 0 and (r := ranks.get(p := part[h] + spelt)) is not None:
            heapq.heappush(queue, (r, h, p))
    return [ranks[p] for p in part if p is not None]


class BytePairEncoder:
    """Encodes and decodes texts by a table of ranks; special tokens have no meaning in a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).finditer
        self.kept: dict[str, list[int]] = {}

    @functools.cached_property
    def strings(self) -> dict[int, bytes]:
        return {n: s for s, n in self.ranks.items()}

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merge(raw, self.ranks)
        if len(raw) <= KEPT_BYTES:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for an empty or null text."""
        out: list[int] = []
        kept = self.kept
        for found in self.find(text or ""):
            word = found.group()
            out += kept.get(word) or self.word(word)
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        return None if ids is None else b"".join(self.strings[int(n)] for n in ids).decode("utf-8", "replace")


_OWN: dict[int, BytePairEncoder] = {}


def _encoder(shared: Broadcast) -> BytePairEncoder:
    """One encoder for each Python worker, with the words it has met."""
    key = id(shared.value)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = BytePairEncoder(*shared.value)
    return _OWN[key]


class Tokenizer:
    """A public tokenizer for use in queries. The driver reads its vocabulary file (about 50,000 strings, the size
    of the file whatever the data) from ``folder`` and sends it to the executors."""

    def __init__(
        self, spark: SparkSession, folder: str = DEFAULT_FOLDER, name: str = "byte_bpe_50k.tiktoken", pattern: str = PATTERN
    ) -> None:
        self.shared = spark.sparkContext.broadcast((read_ranks(str(Path(folder) / name)), pattern))

    def encoder(self) -> Callable[[], Callable[[str | None], list[int]]]:
        """For use in a Python worker: gives the function that encodes a text."""
        shared = self.shared
        return lambda: _encoder(shared).encode

    def ids(self, text: Column) -> Column:
        """The token ids of ``text`` as array<int>; an empty array for empty and null texts."""
        shared = self.shared

        @F.pandas_udf(ArrayType(IntegerType()))
        def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = _encoder(shared)
            for part in parts:
                yield pd.Series([own.encode(t) for t in part], dtype=object)

        return encode(text)

    def count(self, text: Column) -> Column:
        """The number of tokens of ``text``."""
        shared = self.shared

        @F.pandas_udf("int")
        def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = _encoder(shared)
            for part in parts:
                yield pd.Series([len(own.encode(t)) for t in part], dtype="int32")

        return counted(text)

    def text(self, ids: Column) -> Column:
        """The text of token ids: the vocabulary's strings one after the other. Null for null."""
        shared = self.shared

        @F.pandas_udf(StringType())
        def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = _encoder(shared)
            for part in parts:
                yield pd.Series([own.decode(x) for x in part], dtype=object)

        return decode(ids)
