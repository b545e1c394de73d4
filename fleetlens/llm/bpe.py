"""Byte-level BPE encoding and decoding by a rank queue.

A text is cut by a pattern into pre-tokens; each is encoded for itself.  The parts of a pre-token are
a linked list, and every pair of neighbours whose bytes are a token waits in the bucket of
that token's rank.  A hierarchical bitmap says by find-first-set which
rank is least; its leftmost place is merged.  A merge changes the pairs beside it: their old
entries go stale where they are and are skipped when they come up.  So a merge costs a fixed number of steps and a
pre-token of n bytes about n log n, also where it is a whole document of one letter.

A vocabulary is a file of lines ``base64 rank``.  It is read on the driver, at most ``MAX_BYTES``, and broadcast, so no executor needs
the file.  Texts are not shuffled; each is one row, encoded in stretches of ``STRETCH`` characters
of pre-tokens.  Pre-tokens met before come from a memo of at most twice ``MEMO`` entries a worker, which only saves time.

Defined results: a null or empty text has no tokens (empty ids); bytes that are no UTF-8 count as U+FFFD; null ids
decode to null; an unknown id is an error; equal rows give equal rows; an empty table gives no rows; extra columns are
kept (or those named in ``keep``), and give way to result columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from .frames import any_names, column

MAX_BYTES = 64 << 20
MEMO, MEMO_CHARS = 1 << 18, 64
STRETCH = 1 << 16  # pre-tokens that are held at once


class RankQueue:
    """Places in buckets by rank; gives the least rank first and in it the leftmost place.

    The bitmap has two levels of equally long words: bit r of ``low`` says that bucket r holds something, bit i of
    ``top`` that word i of ``low`` does."""

    __slots__ = ("shift", "mask", "bits", "low", "top", "buckets")

    def __init__(self, ranks: int):
        self.shift = max(1, (max(ranks, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.shift) - 1
        self.low = [0] * ((ranks >> self.shift) + 1)
        self.bits = [1 << i for i in range(max(self.mask + 1, len(self.low)))]
        self.top = 0
        self.buckets: list[None | int | list[int]] = [None] * ranks  # nothing, one place, or a heap of places

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = place
            i = rank >> self.shift
            w = self.low[i]
            self.low[i] = w | self.bits[rank & self.mask]
            if not w:
                self.top |= self.bits[i]
        elif type(bucket) is int:
            self.buckets[rank] = [bucket, place] if bucket < place else [place, bucket]
        else:
            heappush(bucket, place)

    def pop(self) -> tuple[int, int]:
        """The least rank and its leftmost place (the queue is not empty: ``top`` is not 0)."""
        i = (self.top & -self.top).bit_length() - 1
        w = self.low[i]
        least = w & -w
        rank = i << self.shift | least.bit_length() - 1
        bucket = self.buckets[rank]
        if type(bucket) is not int:
            if len(bucket) > 1:
                return rank, heappop(bucket)
            bucket = bucket[0]
        self.buckets[rank] = None
        self.low[i] = w = w ^ least
        if not w:
            self.top ^= self.bits[i]
        return rank, bucket


class Tokenizer:
    """Ranks of byte strings, and the pattern that cuts texts into pre-tokens."""

    def __init__(self, vocabulary: bytes, pattern: str):
        lines = (x.split() for x in vocabulary.splitlines() if x.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes = {r: b for b, r in self.ranks.items()}
        if len(self.bytes) < len(self.ranks) or any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("a vocabulary holds every single byte, and every rank once")
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(self.bytes) + 1)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, rank_of, queue, longest = len(piece), self.ranks.get, self.queue, self.longest
        push, pop = queue.push, queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [rank_of(piece[p:p + 2], -1) for p in range(n)]  # rank of the pair that begins here; -1: none, or merged away
        waits[-1] = -1
        for p, rank in enumerate(waits):
            if rank >= 0:
                push(rank, p)
        while queue.top:
            rank, p = pop()
            if waits[p] != rank:
                continue  # stale
            q = after[p]
            waits[q] = -1
            after[p] = r = after[q]
            if r < n:
                before[r] = p
                end = after[r]
                waits[p] = rank = rank_of(piece[p:end], -1) if end - p <= longest else -1
                if rank >= 0:
                    push(rank, p)
            else:
                waits[p] = -1
            q = before[p]
            if q >= 0:
                waits[q] = rank = rank_of(piece[q:r], -1) if r - q <= longest else -1
                if rank >= 0:
                    push(rank, q)
        out, p = [], 0
        while p < n:
            out.append(self.ranks[piece[p:after[p]]])
            p = after[p]
        return out

    def piece(self, text: str) -> bytes:
        """Ids of a pre-token that is not in the memo."""
        ids = self.older.get(text)
        if ids is None:
            ids = b"".join([i.to_bytes(4, "little") for i in self.merged(text.encode())])
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:  # what was not met again since the last turn is forgotten
                self.memo, self.older = {}, self.memo
            self.memo[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the text, four bytes each, little-endian."""
        if len(text) <= STRETCH:
            return self._pieces(self.pattern.findall(text))
        pieces = (m[0] for m in self.pattern.finditer(text))
        return b"".join(map(self._pieces, iter(lambda: list(islice(pieces, STRETCH)), [])))

    def _pieces(self, pieces: list[str]) -> bytes:
        have = self.memo.get
        out = list(map(have, pieces))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    out[i] = self.memo.get(pieces[i]) or self.piece(pieces[i])
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I")))


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(vocabulary: bytes, pattern: str) -> Tokenizer:
    """The tokenizer of this worker process, which keeps its memo from task to task."""
    key = (hashlib.sha256(vocabulary).hexdigest(), pattern)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(vocabulary, pattern)
    return _tokenizers[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"a vocabulary has at most {MAX_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def _map(df: DataFrame, of: str, result: str, keep: list[str] | None, vocabulary, pattern: str, one) -> DataFrame:
    """``df`` with ``result``: ``one`` of the tokenizer and each value (as bytes or None) of ``of``."""
    fields = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() != result]
    names = [f.name for f in fields]

    def run(batches):
        t = tokenizer(vocabulary.value, pattern)
        for batch in batches:
            new = pa.array([one(t, v.as_py()) for v in batch.column(len(names))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], new], names=[*names, result])

    return df.select(*[column(df, n) for n in names], column(df, of).cast("binary").alias(result)) \
        .mapInArrow(run, T.StructType([*fields, T.StructField(result, T.BinaryType())]))


@any_names
def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``ids``: the text's token ids, four bytes each, little-endian."""
    return _map(df, text, "ids", keep, _vocabulary(df, vocabulary), pattern,
                lambda t, v: b"" if v is None else t.encode(v.decode("utf-8", "replace")))


@any_names
def decode(df: DataFrame, vocabulary: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``decoded``: the bytes that the ids stand for."""
    return _map(df, ids, "decoded", keep, _vocabulary(df, vocabulary), "", lambda t, v: None if v is None else t.decode(v))
