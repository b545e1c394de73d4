"""Removal of repeated passages by line hashing.

Units are the lines of a text that have a word, normalised (compatibility form,
case folded, white space as one space).  128-bit digests are grouped over all documents, and of
equal lines the one ranked first, by doc_id and then place, is kept.
Repeats that stand together are removed if they have ``min_words`` words together, so a passage of several
lines is found and a short line that many texts share stays.  A first occurrence is
never removed, so no line disappears from the corpus.  What remains keeps its offsets in the original.

With ``sentences``, lines are cut further, after a sentence's end mark and white space, and the same rule holds for
runs of sentences (across lines too): a passage that stands inside a longer line is found, but for what it shares of
the sentences at its two ends.  As a line's sentences are repeats if the line is, every run of lines is found as well.

Digests are pre-aggregated, so a very common line is one row a task; where lines
are compared with the first ones, a common line is only a hot key of a plain join, which
Spark splits.  The texts are shuffled once, by row.

Defined results: null or empty text: nothing removed (null stays null); a null doc_id ranks last;
of equal rows the first keeps its text and in the others every line is a repeat; an empty table
gives no rows; extra columns are kept, and give way to result columns of the same name.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .frames import any_names, row_hash, saved, unused

MIN_WORDS = 50
#: for sentences: a passage of 50 words loses those of the sentences at its two ends that are joined to other text
PASSAGE_WORDS = 30
ROWS = 500
#: between sentences of a line: white space after an end mark (and a closing quote or bracket); after an ideographic one also none
_ENDS = r"[.!?…‼⁇-⁉․‥．！？﹒﹖﹗。｡]"
BREAK = re.compile(rf"(?:(?<={_ENDS})|(?<={_ENDS}[\"'’”)\]＂＇）］]))[^\S\n]+|(?<=[。｡])(?=\S)")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = T.StructType([T.StructField("kept", SPAN), T.StructField("removed", SPAN), T.StructField("n_removed", T.LongType())])
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def digest(line: str) -> bytes | None:
    """128 bits of the normalised line (null: it has no word)."""
    words = unicodedata.normalize("NFKC", line).casefold().split()
    return xxhash.xxh3_128_digest(" ".join(words)) if words else None


def _slices(batches):
    """The batches in parts of ``ROWS`` rows, so that a task's Python holds the units of few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
            pa.default_memory_pool().release_unused()


def spans(text: str, sentences: bool) -> list[tuple[int, int]]:
    """Start and end of the text's lines, or of the sentences of its lines, in order."""
    out, at = [], 0
    for line in text.split("\n"):
        begin = at
        if sentences:
            for m in BREAK.finditer(line):
                out.append((begin, at + m.start()))
                begin = at + m.end()
        out.append((begin, at + len(line)))
        at += len(line) + 1
    return out


def _units(sentences: bool):
    """One row for each unit with a word: the text's row, the unit's number and digest."""

    def run(batches):
        for batch in _slices(batches):
            doc, number, digests = array("q"), array("i"), []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                for n, (a, b) in enumerate(spans(text, sentences)):
                    if (d := digest(text[a:b])) is not None:
                        doc.append(i)
                        number.append(n)
                        digests.append(d)
            rows = pa.array(np.frombuffer(doc, np.int64))
            key = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows) for c in ("id", "x", "y")] + [pa.array(np.frombuffer(number, np.int32)), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy())],
                names=["id", "x", "y", "line", "h", "l"])
    return run


def cut(text: str | None, repeats: set[int], every: bool, min_words: int, sentences: bool = False):
    """The text without its runs of repeated units, the spans kept and removed, and the words removed."""
    if text is None or not (repeats or every):
        whole = [] if not text else [{"start": 0, "end": len(text)}]
        return text, whole, [], 0
    places = spans(text, sentences)
    lines = [text[a:b] for a, b in places]
    drop, run, words = set(), [], 0
    for n, line in enumerate([*lines, None]):
        size = 0 if line is None else len(line.split())
        if line is not None and (n in repeats or every and size):
            run.append(n)
            words += size
        elif line is None or size:
            if words >= min_words:
                drop.update(run)
            run, words = [], 0
        elif run:
            run.append(n)  # a blank line inside a run
    parts, removed_words = {True: [], False: []}, 0
    for n, (line, (start, end)) in enumerate(zip(lines, places)):
        own = parts[n in drop]
        if own and own[-1]["line"] == n - 1:
            own[-1] |= {"end": end, "line": n}
        else:
            own.append({"start": start, "end": end, "line": n})
        removed_words += len(line.split()) if n in drop else 0
    plain = {k: [{"start": s["start"], "end": s["end"]} for s in v] for k, v in parts.items()}
    return "\n".join(text[s["start"]:s["end"]] for s in plain[False]), plain[False], plain[True], removed_words


def _cutter(names: list[str], text: str, out: list[str], lines: str, copy: str, min_words: int, sentences: bool):
    def run(batches):
        for batch in _slices(batches):
            done = [cut(t.as_py(), set(r.as_py() or ()), c.as_py() > 0, min_words, sentences) for t, r, c in zip(
                batch.column(names.index(text)), batch.column(names.index(lines)), batch.column(names.index(copy)))]
            new = {text: pa.array([d[0] for d in done], pa.string()), "kept": pa.array([d[1] for d in done], _SPAN),
                   "removed": pa.array([d[2] for d in done], _SPAN), "n_removed": pa.array([d[3] for d in done], pa.int64())}
            old = {k: batch.column(i) for i, k in enumerate(names)}
            yield pa.RecordBatch.from_arrays([(old | new)[k] for k in out], names=out)
    return run


@any_names
def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                 sentences: bool = False) -> DataFrame:
    """``docs`` with ``text`` cut, ``kept`` and ``removed`` (spans of code points in the original text;
    the kept ones, joined by line ends, are ``text``) and ``n_removed`` (words).  Units are lines, or ``sentences``."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULT.names])
    x, y, rx, ry, lines, copy, n = unused(docs, "x", "y", "rx", "ry", "lines", "copy", "n")
    marked = docs.withColumns(dict(zip((x, y), row_hash(docs))))
    slim = marked.select(F.col(doc_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(text).alias("text"))
    units = saved(slim.mapInArrow(_units(sentences), T.StructType([
        *slim.schema.fields[:3], T.StructField("line", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("l", T.LongType())])))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "x", "y", "line")
    first = units.groupBy("h", "l").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    # kept apart, so that both sides of the join are dealt out for it and a common line's rows can be split
    first = saved(first.select("h", "l", "first.x", "first.y", "first.line").toDF("h", "l", "fx", "fy", "fline"))
    later = (F.col("x") != F.col("fx")) | (F.col("y") != F.col("fy")) | (F.col("line") != F.col("fline"))
    repeats = units.join(first, ["h", "l"]).where(later).groupBy(F.col("x").alias(rx), F.col("y").alias(ry)) \
        .agg(F.collect_set("line").alias(lines))
    once = marked.groupBy(x, y).agg(*[F.first(c).alias(c) for c in docs.columns], F.count(F.lit(1)).alias(n))
    joined = once.join(repeats, (once[x] == repeats[rx]) & (once[y] == repeats[ry]), "left") \
        .select(*docs.columns, lines, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy))
    joined = joined.withColumn(copy, (F.col(copy) - 1).cast("int"))
    out = [*docs.columns, *RESULT.names]
    return joined.mapInArrow(_cutter(joined.columns, text, out, lines, copy, min_words, sentences),
                             T.StructType([*docs.schema.fields, *RESULT.fields]))
