"""Phrase collocation mining with broadcast double-array tries.

Texts are cut into pieces and words.  A phrase of k words with ``least`` places has parts with at least as many, so
infrequent words end a stretch of text like a piece's end does, and the search goes up by length:

1. Words are counted by language; the frequent ones get numbers, and the texts are stored as numbers, with 0 between stretches.
2. Level by level, a double-array trie of the candidates found so far is broadcast, and numpy advances the states of all text positions
   at once, one word after another.  A position in an accepting state of ``k - 1`` words, with a frequent word behind, is a
   candidate of ``k`` words; only those whose sums over all shards of the text reach ``least`` are safe to keep (none is lost: a
   candidate's places are places of its first part).  So a trie never holds more than the frequent phrases.
3. One pass with the trie of all candidates counts them: bincounts of accepting states, summed over the shards.
4. Cuts, scores and containment are joins on the candidates, with decimal arithmetic of 38 digits.

What is broadcast has a bound: a dictionary has at most ``MAX_WORDS`` words and a trie at most ``MAX_PHRASES`` accepting
phrases (with their beginnings, fewer than five times as many nodes); more of them take more passes over the text, each with a share by hash.
Counts are added up in each task before they are shuffled, so a very common word or phrase is one entry a task and group of texts; they travel
in rows of many (buckets, whose number grows with the text; vectors of ``VECTOR`` phrases).  A language that most rows have is no unit of work but in the final ranks, where tasks send ``top`` rows each.

Defined results: null language: ``und`` (one with rows that say so); null or empty text: no words; repeated rows count each; ties as the order
says; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.skew import top_n
from ..session import shared_dir
from .frames import saved
from .words import LOWER, mixed

LONGEST, LEAST, TOP = 5, 100, 2000
BREAKS, SPACES = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?\n\x0b\x0c\r", b" \t"))  # ASCII, so no part of another character
MAX_WORDS, MAX_PHRASES = 1 << 20, 1 << 20
GROUP = 4 << 20      # bytes of text that are worked on together, a quarter of those of numbers; one longer text is by itself
BITS = 10            # a word's number is walked in symbols of so many bits
WIDTH = 1 << BITS
LARGE = 64           # children of a state from which on a place is searched for it alone
BUCKET = 1 << 20     # pairs of a bucket, on average at most
VECTOR = 512         # counts of phrases that travel together
SUMS, TOTALS = "bucket bigint, pairs binary, n binary", "part bigint, n binary"


def _slices(sizes: np.ndarray, group: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``group`` bytes together."""
    size, first = np.cumsum(sizes), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + group, "right")))
        yield first, last
        first = last


def _lowered(texts: pa.Array) -> pa.Array:
    """A-Z made a-z, in buffers of its own (Arrow's ``ascii_lower`` was seen to go wrong on slices far into a column)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(LOWER[data]))


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, int, int]]:
    """Group by group: the words, their rows' languages, their pieces and rows (counted in the group), and the range of rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    for first, last in _slices(sizes.astype(np.int64), GROUP):
        lang, text = (batch.column(i).slice(first, last - first) for i in (0, 1))
        lang = pc.fill_null(lang.cast(pa.large_string()), "und")
        text = _lowered(text)
        at, data = np.frombuffer(text.buffers()[1], np.int64), np.frombuffer(text.buffers()[2], np.uint8)
        edge, real = np.zeros(len(data) + 1, bool), ~(BREAKS | SPACES)[data]
        edge[at] = True
        start = np.flatnonzero(real & (edge[:-1] | ~np.append(False, real[:-1])))
        end = np.flatnonzero(real & (edge[1:] | ~np.append(real[1:], False))) + 1
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(0, np.cumsum(end - start))), pa.py_buffer(data[real]))
        piece = np.cumsum(BREAKS[data] | edge[:-1], dtype=np.int32)[start]
        row = np.repeat(np.arange(last - first), np.diff(np.searchsorted(start, at)))
        yield words, lang.take(pa.array(row)), piece, row, first, last


def _encoded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    d = values.dictionary_encode()
    return d.dictionary, d.indices.to_numpy().astype(np.int64)


def _count_words(batches):
    """lang, word and count of each group of texts."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        for words, lang, *_ in _tokens(batch):
            w, wi = _encoded(words)
            g, gi = _encoded(lang)
            key, n = np.unique(gi * len(w) + wi, return_counts=True)
            at = max(len(w), 1)
            yield pa.RecordBatch.from_arrays([g.take(pa.array(key // at)).cast(pa.string()), w.take(pa.array(key % at)).cast(pa.string()),
                                              pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _number_words(dictionary, more: bool, last: bool):
    """Each text as the numbers of its words that the dictionary has, with 0 for others and ahead of pieces; ``more``: joined
    with those that an earlier dictionary gave; ``last``: without the text, and of zeros in a row one is left."""
    def run(batches):
        langs, words, numbers = dictionary.value
        own = {g: (words.filter(at), np.append(numbers.filter(at).to_numpy(), 0).astype(np.int32))
               for g in pc.unique(langs).to_pylist() for at in [pc.equal(langs, g)]}
        for batch in batches:
            pa.default_memory_pool().release_unused()
            out = []
            for w, lang, piece, row, first, to in _tokens(batch):
                found = np.zeros(len(w), np.int32)
                for g in set(pc.unique(lang).to_pylist()) & own.keys():
                    at = np.flatnonzero(pc.equal(lang, g).to_numpy(zero_copy_only=False))
                    d, di = _encoded(w.take(pa.array(at)))
                    found[at] = own[g][1][pc.fill_null(pc.index_in(d, own[g][0]), -1).to_numpy()][di]
                begins = np.flatnonzero(np.diff(piece, prepend=-1))
                found, row = np.insert(found, begins, 0), np.insert(row, begins, row[begins])
                if more:
                    found = np.maximum(found, np.frombuffer(b"".join(batch.column(2).slice(first, to - first).to_pylist()), np.int32))
                if last:
                    keep = found != 0
                    keep[1:] |= (found[:-1] != 0) | (row[1:] != row[:-1])
                    keep[:1] = True
                    found, row = found[keep], row[keep]
                ends = np.searchsorted(row, np.arange(to - first + 1)) * 4
                data = found.tobytes()
                out += [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            kept = [] if last else [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], names=["lang", "text", "numbers"][2 * last:])
    return run


def _numbers(batches) -> Iterator[np.ndarray]:
    """Numbers of many texts in a row, each text's first one 0, and a 0 at the end."""
    for batch in batches:
        rows = batch.column(0)
        for a, b in _slices(pc.binary_length(rows).to_numpy(zero_copy_only=False).astype(np.int64), 4 * GROUP):
            whole = np.frombuffer(b"".join(rows.slice(a, b - a).to_pylist()), np.int32)
            if len(whole):
                yield np.append(whole, np.int32(0))


def _placed(symbol: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Slots of first children, so that no two children share one: family i has the ascending symbols from ``begin[i]`` on, each as far behind
    the first child's slot as its symbol is.  The slots below WIDTH are left, so that no base is negative.

    Large families come first, one after another behind all places that were tried; those of less than LARGE children are dealt at random,
    all of about a size at once, where slots are free, with more slots when few fit; only children go into what is left.  So the
    time is in proportion to the children, and no search begins again at the front."""
    count, off = np.diff(np.append(begin, len(symbol))), symbol - np.repeat(symbol[begin], np.diff(np.append(begin, len(symbol))))
    first, random = np.zeros(len(begin), np.int64), np.random.Generator(np.random.PCG64(len(symbol)))
    taken = np.zeros(len(symbol) + len(symbol) // 8 + 4 * WIDTH, bool)
    taken[:WIDTH] = True
    at, tries = WIDTH, np.arange(64)[:, None]
    large = np.flatnonzero(count >= LARGE)
    for j in large[np.argsort(-count[large], kind="stable")]:
        own = off[begin[j]:begin[j] + count[j]]
        while True:
            if at + 2 * WIDTH > len(taken):
                taken = np.append(taken, np.zeros(len(taken) // 4, bool))
            fits = ~taken[at:at + 64]
            fits[fits] = ~taken[at + tries[fits] + own].any(axis=1)
            if fits.any():
                break
            at += 64
        first[j] = at + int(fits.argmax())
        taken[first[j] + own] = True
    owner = np.zeros(len(taken), np.int32)
    for least in (LARGE >> i for i in range(1, LARGE.bit_length() - 1)):
        left, tried, won = np.flatnonzero((count >= least) & (count < 2 * least)), 0, 0
        while len(left):
            ends = np.cumsum(count[left])
            starts = ends - count[left]
            child = np.arange(ends[-1]) + np.repeat(begin[left] - starts, count[left])
            slot = random.integers(WIDTH, len(taken) - WIDTH, len(left))
            slots, of = np.repeat(slot, count[left]) + off[child], np.repeat(np.arange(len(left), dtype=np.int32), count[left])
            free = ~np.logical_or.reduceat(taken[slots], starts)
            owner[slots[free[of]]] = of[free[of]]  # of some that want a slot at once, one has it
            free &= np.logical_and.reduceat(owner[slots] == of, starts)
            first[left[free]] = slot[free]
            taken[slots[free[of]]] = True
            tried, won, left = tried + len(left), won + int(free.sum()), left[~free]
            if tried >= 256:
                if won * 32 < tried:
                    taken, owner = (np.append(x, np.zeros(len(x) // 4, x.dtype)) for x in (taken, owner))
                tried = won = 0
    only = np.flatnonzero(count == 1)
    free = np.flatnonzero(~taken)[:len(only)]
    first[only] = np.append(free, len(taken) + np.arange(len(only) - len(free)))
    return first


class DoubleArray:
    """A trie of phrases as two arrays: the child of state s by symbol c is ``base[s] + c``, if ``check`` there says s.

    A word's number is ``digits`` symbols of ``BITS`` bits.  State 0 is none and state 1 the root.  ``accepts`` gives the place of the phrase that ends
    in a state, or -1.  ``depth``: words of the longest phrase."""

    def __init__(self, phrases: list[np.ndarray] | pa.ListArray, most: int):
        """``phrases``: distinct sequences of numbers; ``most``: the largest number there is."""
        if not isinstance(phrases, pa.Array):
            phrases = pa.array(phrases, pa.list_(pa.int32()))
        self.digits = max(1, -(-int(most).bit_length() // BITS))
        size = pc.list_value_length(phrases).to_numpy(zero_copy_only=False)
        self.depth = int(size.max(initial=0))
        paths = np.full((len(phrases), self.depth), -1, np.int32)
        paths[np.arange(self.depth) < size[:, None]] = phrases.flatten().to_numpy()
        order = np.lexsort(paths.T[::-1]) if self.depth else np.arange(len(paths))
        paths = paths[order]
        parent, symbol, ends = self._nodes(paths)
        begin = np.flatnonzero(np.diff(parent, prepend=-1))  # a parent's children stand together
        first = _placed(symbol, begin)
        state = np.repeat(first - symbol[begin], np.diff(np.append(begin, len(symbol)))) + symbol
        top = int(state.max(initial=0)) + 1 + WIDTH  # no base and symbol lead beyond
        state = np.append(1, state)  # of the root, then of the nodes
        self.base, self.check, self.accepts = np.zeros(top, np.int32), np.full(top, -1, np.int32), np.full(top, -1, np.int32)
        self.base[state[parent[begin]]] = first - symbol[begin]
        self.check[state[1:]] = state[parent]
        self.accepts[state[ends]] = order
        self.accepts[:2] = -1

    def _nodes(self, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted paths: each node's parent and symbol, depth by depth (nodes count from 1, the root is 0), and the node where each path ends."""
        at, fresh = np.zeros(len(paths), np.int64), np.arange(len(paths)) == 0
        parents, symbols, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for word in paths.T:
            here = word >= 0
            fresh[1:] |= here[1:] & ~here[:-1]
            for d in reversed(range(self.digits)):
                symbol = word >> BITS * d & WIDTH - 1
                fresh[1:] |= symbol[1:] != symbol[:-1]
                new = fresh & here
                parents.append(at[new])
                symbols.append(symbol[new].astype(np.int64))
                at = np.where(here, n + np.cumsum(new), at)
                n += len(symbols[-1])
        return np.concatenate(parents), np.concatenate(symbols), at

    def walk(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """After each word: its count, the places whose state is still alive, and their states."""
        place, state = np.flatnonzero(numbers[:-1]), None
        state = np.ones(len(place), np.int32)
        for k in range(self.depth):
            word = numbers[np.minimum(place + k, len(numbers) - 1)]
            for d in reversed(range(self.digits)):
                to = self.base[state] + (word >> BITS * d & WIDTH - 1)
                state = np.where(self.check[to] == state, to, 0)
            alive = np.flatnonzero(state)
            place, state = place[alive], state[alive]
            yield k + 1, place, state


def _sums(left: np.ndarray, right: np.ndarray, buckets: int) -> pa.RecordBatch:
    """How often each pair stands there: sorted pairs (as differences, which pack well) and counts, a row for each bucket.

    Pairs are dealt to buckets by their left part and a range of their right one, so none grows with a common word."""
    key, n = np.unique(left.astype(np.int64) << 32 | right, return_counts=True)
    bucket = (mixed((key >> 12).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    key, n, bucket = key[order], n[order].astype(np.int64), bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first[1:], len(key))
    pairs = [np.diff(key[a:b], prepend=0).tobytes() for a, b in zip(first, ends)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), pa.array(pairs, pa.binary()),
                                       pa.array([n[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["bucket", "pairs", "n"])


def _frequent(least: int):
    """A bucket's pairs with ``least`` places in all shards."""
    def run(table: pa.Table) -> pa.Table:
        key = np.concatenate([np.cumsum(np.frombuffer(x.as_py(), np.int64)) for x in table.column("pairs")])
        n = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("n")])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.add.reduceat(n[order], first)
        safe = n >= least
        key = key[first][safe]
        return pa.table({"id": key >> 32, "number": (key & 0xFFFFFFFF).astype(np.int32)})
    return run


def _pairs(buckets: int):
    """Frequent words side by side."""
    def run(batches):
        for x in _numbers(batches):
            ok = (x[:-1] > 0) & (x[1:] > 0)
            yield _sums(x[:-1][ok], x[1:][ok], buckets)
    return run


def _extended(trie, k: int, buckets: int):
    """Frequent phrases of k - 1 words with a frequent word behind."""
    def run(batches):
        t, ids = trie.value
        for x in _numbers(batches):
            for words, place, state in t.walk(x):
                if words == k - 1:
                    of, behind = t.accepts[state], x[place + words]
                    ok = (of >= 0) & (behind > 0)
                    yield _sums(ids[of[ok]], behind[ok], buckets)
    return run


def _counted(trie):
    """How often each phrase of the trie stands in the shard, in parts of VECTOR phrases in the order of their ids."""
    def run(batches):
        t, ids = trie.value
        total = np.zeros(len(ids), np.int64)
        for x in _numbers(batches):
            for _, _, state in t.walk(x):
                of = t.accepts[state]
                total += np.bincount(of[of >= 0], minlength=len(ids))
        part = ids // VECTOR
        first = np.flatnonzero(np.diff(part, prepend=-1))
        whole = np.zeros((len(first), VECTOR), np.int64)
        whole[np.cumsum(np.diff(part, prepend=-1) != 0) - 1, ids % VECTOR] = total
        some = whole.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(part[first][some], pa.int64()), pa.array([x.tobytes() for x in whole[some]], pa.binary())],
                                         names=["part", "n"])
    return run


def _summed(table: pa.Table) -> pa.Table:
    n = np.zeros(VECTOR, np.int64)
    for x in table.column("n"):
        n += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"id": table.column("part")[0].as_py() * VECTOR + np.arange(VECTOR), "a": n})


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _shares(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """``df`` in shares by hash of which none has more than ``most`` rows."""
    n = 1
    while True:
        share = F.pmod(F.xxhash64(key), F.lit(n))
        largest = df.groupBy(share.alias("s")).count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            return [df.where(share == i) for i in range(n)] if n > 1 else [df]
        n *= 2


def _with_number(df: DataFrame, number: str) -> tuple[DataFrame, int]:
    """``df``, stored, with numbers from 1 without gaps, and the largest: a row's place in its task and the sum of the tasks before."""
    some = saved(df.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    per = sorted((r["p"], r["n"]) for r in some.groupBy(task.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    begins = np.cumsum([0] + [n for _, n in per]).tolist()
    begin = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(per, begins)], "_p long, _b long")
    at = F.col("_b") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return saved(some.join(begin, task == F.col("_p")).select(*df.columns, at.cast("int").alias(number))), begins[-1]


def _tries(phrases: DataFrame, most: int, max_phrases: int):
    """Broadcast (trie, ids in ascending order) of each share of ``phrases`` (id, path)."""
    for share in _shares(phrases, "id", max_phrases):
        rows = share.select("id", "path").toArrow().sort_by("id")
        paths = rows.column("path").combine_chunks()
        ids = rows.column("id").to_numpy().astype(np.int64)
        if len(ids):
            yield phrases.sparkSession.sparkContext.broadcast((DoubleArray(paths, most), ids))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
            max_words: int = MAX_WORDS, max_phrases: int = MAX_PHRASES) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, a`` of the phrases of 2 to ``longest`` words with ``least`` places, and ``lang, word, n, all`` of the frequent words
    (``all``: word occurrences of the language)."""
    spark = docs.sparkSession
    slim = docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    counts = slim.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the other words only count together
    counts = saved(counts.groupBy("lang", F.when(F.col("n") >= least, F.col("word")).alias("word")).agg(F.sum("n").alias("n")))
    every = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    words, most = _with_number(counts.where("word IS NOT NULL"), "number")
    buckets = 1 + (every.agg(F.sum("all")).first()[0] or 0) // BUCKET
    numbered, shares = slim, _shares(words, "number", max_words)
    for i, share in enumerate(shares):
        rows = share.select("lang", "word", "number").toArrow()
        own = spark.sparkContext.broadcast(tuple(rows.column(c).combine_chunks().cast(t) for c, t in (
            ("lang", pa.large_string()), ("word", pa.large_string()), ("number", pa.int32()))))
        last = i == len(shares) - 1
        numbered = numbered.mapInArrow(_number_words(own, i > 0, last), "numbers binary" if last else "lang string, text string, numbers binary")
        numbered = _stored(numbered, "collocation-numbers")

    found, behind = [], words.select("number", F.col("word").alias("behind"))
    before = words.select(F.col("number").alias("id"), "lang", F.col("word").alias("phrase"), F.array("number").alias("path"))
    sums = [numbered.mapInArrow(_pairs(buckets), SUMS)]
    for k in range(2, longest + 1):
        if k > 2:
            sums = [numbered.mapInArrow(_extended(t, k, buckets), SUMS) for t in _tries(before, most, max_phrases)]
        if not sums:
            break
        safe = reduce(DataFrame.union, sums).groupBy("bucket").applyInArrow(_frequent(least), "id bigint, number int")
        before, _ = _with_number(safe.join(before, "id").join(behind, "number").select(
            "lang", F.concat_ws(" ", "phrase", "behind").alias("phrase"), F.concat("path", F.array("number")).alias("path")), "id")
        found.append(before)
    candidates, _ = _with_number(reduce(DataFrame.union, found).drop("id"), "id")
    totals = [numbered.mapInArrow(_counted(t), TOTALS) for t in _tries(candidates, most, max_phrases)]
    totals = reduce(DataFrame.union, totals, spark.createDataFrame([], TOTALS))
    totals = totals.groupBy("part").applyInArrow(_summed, "id bigint, a bigint").where(F.col("a") >= least)
    out = saved(candidates.join(totals, "id").select("lang", "phrase", F.size("path").alias("words"), "a"))
    return out, words.join(every, "lang").select("lang", "word", "n", "all")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
         max_words: int = MAX_WORDS, max_phrases: int = MAX_PHRASES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score, places, and phrase.

    A phrase's score is the least over its cuts of floor(1000 * a * n / (l * r)), the first such cut counts; phrases that stand only inside a
    longer one are left out.  Beyond 38 digits the arithmetic is an error, never a rounded value."""
    every, words = phrases(docs, text, lang, longest, least, max_words, max_phrases)
    split = F.split("phrase", " ")
    # a phrase inside a longer one as often as anywhere is so inside one that has a word more
    inside = every.where("words > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(split, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(split, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    open_ = every.join(inside.distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = open_.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")) \
        .select("lang", "phrase", "a", "cut", F.array_join(F.slice(split, F.lit(1), F.col("cut")), " ").alias("first"),
                F.array_join(F.slice(split, F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("rest"))
    known = saved(every.select("lang", "phrase", "a").union(words.select("lang", "word", "n")))
    total = words.select("lang", F.col("all").alias("n")).distinct()
    whole = "cast({} as decimal(19, 0))".format
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    scored = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]) \
        .join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(total, "lang") \
        .withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least")) \
        .select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")
    ranked = top_n(lowest, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
