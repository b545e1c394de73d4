"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit fingerprint: of the XXH64 values of its word shingles, repeats
included, a bit is 1 if set in over half.  Texts are linked if their
fingerprints differ in at most ``bits`` bits.

Equal fingerprints are one node, so copies cost one row.  To find the other links the 64 bits are cut
into segments.  If two fingerprints differ in at most ``bits`` bits, then in
some segment they differ in at most ``bits // segments`` (and in all but the first
``bits % segments + 1`` segments in one less).  Each fingerprint is stored under
the values of its segments, and looks up all values within that small Hamming
ball; candidates that meet are joined under the full distance, so only true links leave the join.  The
lookup is complete: no bucket is capped.  A segment of 21 or 22 bits holds
about ``n / 2 ** 21`` fingerprints, and looking up costs 46 rows each; fewer segments
(``segments=2``) make smaller buckets for 562 rows each.

Components of the links (``components.py``) give every document the
smallest doc_id that it reaches.

Defined results: null, empty and blank texts have no words and fingerprint zero, linked like any other;
a text of fewer words than a shingle is one shingle; repeated rows share a fingerprint; a null doc_id never names a
component unless all of its documents lack one; an empty table gives no rows; extra
columns are kept (``fingerprints``, ``one_of_each``), and give way to result columns of the same name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .components import components
from .frames import any_names, row_hash, saved, unused

WORDS, BITS, SEGMENTS = 4, 4, 3
SEED = 42
_PIECE = 100_000  # shingles whose bits are counted together


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    w = (text or "").encode().lower().split()  # bytes: A-Z, and the six ASCII spaces
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _PIECE):
        ones += np.unpackbits(h[i:i + _PIECE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``fingerprint``, the 64 bits as a long."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "fingerprint"]
    src = docs.select(*keep, *([text] if text not in keep else []))
    names = src.columns

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(names.index(text))), np.uint64, batch.num_rows)
            old = {k: batch.column(i) for i, k in enumerate(names) if k in keep}
            yield pa.RecordBatch.from_arrays([*old.values(), pa.array(found.view(np.int64))], names=[*old, "fingerprint"])

    fields = [f for f in src.schema.fields if f.name in keep]
    return src.mapInArrow(run, T.StructType([*fields, T.StructField("fingerprint", T.LongType())]))


def plan(bits: int, segments: int) -> list[tuple[int, int, int]]:
    """Offset, width and radius of each segment that must be looked up."""
    if not 0 <= bits < 64 or not 1 <= segments <= 32:
        raise ValueError("0 to 63 bits, 1 to 32 segments")
    out, at = [], 0
    for i in range(segments):
        width = 64 // segments + (i < 64 % segments)
        radius = bits // segments - (i > bits % segments)
        if radius >= 0:
            out.append((at, width, min(radius, width)))
        at += width
    return out


def _key(f: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(f, offset).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``width`` bits."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(nodes: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``a < b``: pairs of distinct fingerprints within ``bits`` bits; ``nodes`` has distinct ``fingerprint``.

    A pair may come once for each segment it meets in.
    """
    f, parts = F.col("fingerprint"), plan(bits, segments)
    stored = nodes.select(f.alias("b"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), _key(f, o, w).alias("k")) for i, (o, w, _) in enumerate(parts)])).alias("s"))

    def ball(i, offset, width, radius):
        masks = F.lit(_ball(width, radius)).cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("i"), _key(f, offset, width).bitwiseXOR(m).alias("k")))

    balls = [ball(i, *p) for i, p in enumerate(parts)]
    asked = nodes.select(f.alias("a"), F.explode(F.concat(*balls)).alias("s"))
    stored, asked = stored.select("b", "s.i", "s.k"), asked.select("a", "s.i", "s.k")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return asked.join(stored, (asked["i"] == stored["i"]) & (asked["k"] == stored["k"]) & near).select("a", "b")


def classes(prints: DataFrame, doc_id: str = "doc_id", bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``fingerprint, root, component_id`` of the distinct fingerprints of ``prints``; a component has one ``root``."""
    nodes = saved(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("least")))
    roots = components(links(nodes, bits, segments))
    named = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left") \
        .select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    # kept apart, so that both sides of the join are dealt out for it and a large component can be split
    named = saved(named)
    smallest = saved(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return saved(named.join(smallest, "root").select("fingerprint", "root", "component_id"))


@any_names
def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row for each row of ``docs``."""
    prints = saved(fingerprints(docs, text, words, keep=[doc_id]))
    return prints.join(classes(prints, doc_id, bits, segments), "fingerprint").select(doc_id, "fingerprint", "component_id")


@any_names
def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null last; then by row hash).

    The texts are shuffled once, by their own row hash, so neither a component nor a
    fingerprint of many rows makes a hot task; equal rows are reduced before the shuffle.
    """
    x, y = unused(docs, "x", "y")
    marked = docs.withColumns(dict(zip((x, y), row_hash(docs))))
    slim = marked.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(x).alias("x"), F.col(y).alias("y"))
    prints = saved(fingerprints(slim, "text", words, keep=["id", "x", "y"]))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x", "y")).alias("first")
    chosen = prints.join(classes(prints, "id", bits, segments), "fingerprint").groupBy("root").agg(first)
    chosen = chosen.select(F.col("first.x").alias("kx"), F.col("first.y").alias("ky"))
    once = marked.dropDuplicates([x, y])
    return once.join(chosen, (once[x] == chosen["kx"]) & (once[y] == chosen["ky"]), "left_semi").drop(x, y)
