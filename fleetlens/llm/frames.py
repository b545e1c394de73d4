"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEX_DIGITS = 13  # of an md5: 52 bits, exact in a double


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    return F.translate(c, UPPER, LOWER)


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate values that clash with no column of ``df``."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        x = f"_{n}"
        while x.lower() in have:
            x = "_" + x
        have.add(x.lower())
        out.append(x)
    return out


def add(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with the columns added; an input column of the same name gives way.

    Columns keep the case given here; every expression may still read the old value.
    """
    keep = [column(df, c) for c in df.columns if c.lower() not in {n.lower() for n in cols}]
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()])


def apart(df: DataFrame, *names: str):
    """``df`` with its columns of these names renamed, and a function that selects ``df``'s columns again."""
    mine = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    other = dict(zip(mine, unused(df, *[f"own_{c}" for c in mine])))

    def restored(out: DataFrame) -> DataFrame:
        return out.select(*[column(out, other.get(c, c)).alias(c) for c in df.columns])

    return df.withColumnsRenamed(other), restored


def any_names(operator):
    """An operator (frame first, frame out) that stands columns of any name: odd ones (``a.b``) have plain ones on the way."""
    @functools.wraps(operator)
    def run(df: DataFrame, *args, **named):
        odd = [c for c in df.columns if not re.fullmatch(r"\w+", c)]
        if not odd:
            return operator(df, *args, **named)
        plain = dict(zip(odd, unused(df, *[f"own_{i}" for i in range(len(odd))])))

        def renamed(x):
            return plain.get(x, x) if isinstance(x, str) else [renamed(c) for c in x] if isinstance(x, list) else x

        out = operator(df.withColumnsRenamed(plain), *map(renamed, args), **{k: renamed(x) for k, x in named.items()})
        return out.withColumnsRenamed({p: c for c, p in plain.items()})
    return run


def hash52(*parts: Column) -> Column:
    """52 bits of the md5 of the parts (as strings, joined by ``:``; null as ``''``), as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return hash52(*parts) / F.lit(float(2 ** (4 * HEX_DIGITS)))


def row_hash(df: DataFrame) -> list[Column]:
    """128 bits that stand for a whole row (equal rows, equal hash; never null)."""
    cols = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else column(df, f.name) for f in df.schema.fields]
    return [F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)]


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder (lineage cut)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
