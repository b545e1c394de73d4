"""Benchmark decontamination by winnowing.

Both sides are cut into words; of every ``W`` consecutive ``K``-word grams the
one with the smallest hash is a fingerprint (the last one on ties).  Any
``K + W - 1 = 10`` words that stand in both have the same smallest gram, so
no shared window is missed.  A document's fingerprints are looked up in the
benchmark's; each match is extended to both sides, word by word, and counts if the
run reaches 10 words.  An item of fewer than 10 words is one window: all its words are one
gram, and a document's grams of that length are all looked up (``W = 1``).

Documents stay where they are: the benchmark's fingerprints are broadcast and
each document is one row in and one row out, without a shuffle.  What is broadcast is bounded:
the benchmark goes in blocks of at most ``BLOCK_WORDS`` words (12 bytes a word
and 24 a fingerprint); a larger benchmark takes more blocks, one after the other, and
after each ``CHAIN`` blocks the documents are checkpointed, so a task never
holds more.  Long items are cut into pieces that overlap by 9 words; that keeps every window.

Defined results: null or empty text: no words, nothing hit; empty benchmark: nothing
is contaminated; items with equal text all count; a repeated item_id counts once;
a null item_id counts under the name ``null``; repeated documents are
judged each for itself; input columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .frames import any_names, hash52, lower_ascii, saved
from .words import ALNUM, covered, grams, groups, lists, mixed

WINDOW = 10
K, W = 5, 6
BLOCK_WORDS = 2_000_000
CHAIN = 4
TURN = 500_000  # pairs of places that are compared at once
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def winnow(g: np.ndarray, doc: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the fingerprints: for each w grams of one text the smallest, the last on ties."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        better = g[j:j + n] <= best
        best[better] = g[j:j + n][better]
        at[better] = j
    within = doc[:n] == doc[w + k - 2:w + k - 2 + n]
    chosen = np.zeros(len(g), bool)
    chosen[(np.arange(n) + at)[within]] = True
    return np.flatnonzero(chosen)


class Block:
    """A part of the benchmark: its words' hashes and, for each gram length, sorted fingerprints."""

    def __init__(self, rows):
        """rows: (name, text) of pieces."""
        self.names = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.names)}
        self.word, self.piece, self.item = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        if not rows:
            self.table = {}
            return
        parts = list(groups(pa.array([r[1] for r in rows], pa.string()), ALNUM, True))
        self.word = np.concatenate([p.hash for p in parts])
        self.piece = np.concatenate([p.doc + p.first for p in parts])
        self.item = np.array([number[r[0]] for r in rows], np.int32)[self.piece]
        size = np.bincount(self.piece, minlength=len(rows))[self.piece]
        self.table = {}
        for n in sorted(set(np.minimum(size, WINDOW).tolist())):
            k, w = (K, W) if n == WINDOW else (n, 1)
            own = np.flatnonzero(np.minimum(size, WINDOW) == n)
            g = grams(self.word[own], k)
            at = winnow(g, self.piece[own], k, w)
            # places whose words around them are equal, as far as a window can reach, tell the same: one of them stands for all
            around = self._around(own[at], k, n)
            order = np.lexsort((around, g[at]))
            prints, around, place = g[at][order], around[order], own[at][order]
            new = np.ones(len(order), bool)
            new[1:] = (prints[1:] != prints[:-1]) | (around[1:] != around[:-1])
            group = np.cumsum(new) - 1
            items = np.unique(np.stack([group, self.item[place]], axis=1), axis=0) if len(order) else np.zeros((0, 2), np.int64)
            self.table[n] = (k, w, prints[new], place[new], np.searchsorted(items[:, 0], np.arange(int(new.sum()) + 1)), items[:, 1])

    def _around(self, place: np.ndarray, k: int, n: int) -> np.ndarray:
        """Hash of the words from n - k before to n - k behind each gram; none beyond its piece."""
        h = np.zeros(len(place), np.uint64)
        for x in range(k - n, n):
            j = np.clip(place + x, 0, max(len(self.word) - 1, 0))
            here = (place + x == j) & (self.piece[j] == self.piece[place])
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.where(here, self.word[j] | np.uint64(1), np.uint64(0)) + np.uint64(x + n))
        return h

    def matches(self, word: np.ndarray, doc: np.ndarray):
        """Which words stand in a run of WINDOW words and more, and the distinct pairs of text and item that share one.

        Worked through in turns: of each only the words hit and the pairs are kept."""
        hit, pairs = np.zeros(len(word), bool), [np.zeros((0, 2), np.int64)]
        for n, (k, w, prints, place, first, items) in self.table.items():
            g = grams(word, k)
            seed = winnow(g, doc, k, w)
            lo = np.searchsorted(prints, g[seed], "left")
            hi = np.searchsorted(prints, g[seed], "right")
            some = hi > lo
            seed, lo, count = seed[some], lo[some], (hi - lo)[some]
            step = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(count) // TURN)) + 1, [len(seed)]])
            for a, b in zip(step[:-1], step[1:]):  # seeds with many places in the benchmark: in turns
                if a < b:
                    c = count[a:b]
                    p = np.repeat(seed[a:b], c)
                    of = np.repeat(lo[a:b], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    start, end, of = self._extended(word, doc, p, place[of], of, k, n)
                    hit |= covered(len(word), start, end)
                    both = np.unique(np.stack([doc[start], of], axis=1), axis=0)
                    size = (first[1:] - first[:-1])[both[:, 1]]
                    at = np.repeat(first[both[:, 1]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    pairs.append(np.unique(np.stack([np.repeat(both[:, 0], size), items[at]], axis=1), axis=0))
                    if sum(map(len, pairs[1:])) > TURN:
                        pairs = [pairs[0], np.unique(np.concatenate(pairs), axis=0)]
        return hit, np.unique(np.concatenate(pairs), axis=0)

    def _extended(self, word, doc, p, q, of, k, n):
        def same(i, j):
            ok = (i >= 0) & (i < len(word)) & (j >= 0) & (j < len(self.word))
            i, j = np.where(ok, i, 0), np.where(ok, j, 0)
            return ok & (word[i] == self.word[j]) & (doc[i] == doc[p]) & (self.piece[j] == self.piece[q])

        whole = np.ones(len(p), bool)
        for x in range(k):
            whole &= same(p + x, q + x)
        p, q, of = p[whole], q[whole], of[whole]
        left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for size, sign, origin in ((left, -1, 0), (right, 1, k - 1)):
            going = np.ones(len(p), bool)
            for x in range(1, n - k + 1):
                going &= same(p + origin + sign * x, q + origin + sign * x)
                size += going
        ok = left + k + right >= n
        return (p - left)[ok], (p + k + right)[ok], of[ok]


def blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[tuple[Block, bool]]:
    """The benchmark in blocks of at most ``block_words`` words, each read when its turn comes, and whether it is the last."""
    step = max(WINDOW, block_words // 8) - (WINDOW - 1)  # words a piece adds
    words = F.regexp_extract_all(lower_ascii(F.coalesce(benchmark[text], F.lit(""))), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("null")).alias("name"), words.alias("w"))
    items = items.where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.lit(step))
    # copies go before blocks are sized, and pieces are dealt by name and text, so any two can be parted
    pieces = items.select("name", F.col("w"), F.explode(starts).alias("at")) \
        .select("name", F.array_join(F.slice("w", F.col("at") + 1, F.lit(step + WINDOW - 1)), " ").alias("t")).distinct()
    pieces = saved(pieces.select("name", "t", hash52(F.col("name"), F.col("t")).alias("h"), F.size(F.split("t", " ")).alias("n")))
    n, most = 1, None
    while most is None or most > block_words:  # more blocks until the largest keeps the bound (or is one piece)
        sizes = pieces.groupBy(F.pmod("h", F.lit(n)).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces"))
        most = sizes.where("pieces > 1").agg(F.max("n")).first()[0] or 0
        if most > block_words:
            n = max(2 * n, -(-most * n // block_words))
    for b in range(n):
        rows = pieces.where(F.pmod("h", F.lit(n)) == b).select("name", "t").collect()
        yield Block([(r["name"], r["t"]) for r in rows]), b == n - 1


def _annotate(names: list[str], text: str, block, more: bool, drop: set[str]):
    """mapInArrow function: adds RESULT, or joins it with what an earlier block found (``more``)."""
    def run(batches):
        for batch in batches:
            found = {k: [] for k in RESULT.names}
            for g in groups(batch.column(names.index(text)), ALNUM, True):
                shared, pairs = block.value.matches(g.hash, g.doc)
                n = np.bincount(g.doc, minlength=g.texts)
                begin = np.concatenate([[0], np.cumsum(n)])
                items = {}
                for o, x in pairs.tolist():
                    items.setdefault(o, set()).add(block.value.names[x])
                if more:
                    old_items = batch.column(names.index("items")).slice(g.first, g.texts).to_pylist()
                    old_spans = batch.column(names.index("spans")).slice(g.first, g.texts).to_pylist()
                    for i, (a, b) in enumerate(zip(old_items, old_spans)):
                        if a:
                            items.setdefault(i, set()).update(a)
                            for x in b:
                                shared[x["start"] + begin[i]:x["end"] + begin[i]] = True
                hit = np.zeros(len(g.hash) + 2, bool)
                hit[1:-1] = shared
                cut = np.zeros(len(hit), bool)  # runs end with their text
                cut[begin[1:-1] + 1] = True
                on = np.flatnonzero(hit[1:] & (~hit[:-1] | cut[1:]))
                off = np.flatnonzero(hit[:-1] & (~hit[1:] | cut[1:]))
                owner = g.doc[on] if len(on) else np.zeros(0, np.int64)
                found["n_words"].append(pa.array(n, pa.int64()))
                found["items"].append(pa.array([sorted(items.get(i, ())) for i in range(g.texts)], pa.list_(pa.string())))
                pairs = pa.StructArray.from_arrays([pa.array(on - begin[owner], pa.int64()), pa.array(off - begin[owner], pa.int64())], ["start", "end"])
                found["spans"].append(lists(pairs, owner, g.texts))
            if batch.num_rows:
                new = {k: pa.concat_arrays(v) for k, v in found.items()}
                old = {k: batch.column(i) for i, k in enumerate(names) if k not in new and k not in drop}
                yield pa.RecordBatch.from_arrays([*old.values(), *new.values()], names=[*old, *new])
    return run


@any_names
def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``items`` (names of the items found, sorted as strings) and
    ``spans`` (runs of hit words, from word ``start`` to before word ``end``).

    ``keep``: columns of ``docs`` to return (all), to save carrying others through the tasks' Python.
    """
    spark = docs.sparkSession
    taken = {n.lower() for n in RESULT.names}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    out = docs.select(*keep, *([text] if text not in keep else []))
    for i, (block, last) in enumerate(blocks(benchmark, item_id, item_text, block_words)):
        drop = {text} - set(keep) if last else set()
        fields = [f for f in out.schema.fields if f.name.lower() not in taken and f.name not in drop]
        schema = T.StructType([*fields, *RESULT.fields])
        out = out.mapInArrow(_annotate(out.columns, text, spark.sparkContext.broadcast(block), i > 0, drop), schema)
        if not last and (i + 1) % CHAIN == 0:
            out = saved(out)
    return out.select(*keep, *RESULT.names)
