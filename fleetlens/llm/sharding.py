"""Sharding by a permutation-filled lookup table (built-in functions only).

Every shard has its own permutation of the slots of a table of prime size
(``offset + j * skip``, both from a hash of the shard's name).  The shards take
turns; at its turn a shard claims the first slot of its permutation that is
still free.  When the table is full, shards own equally many slots (give or
take one), and removing a shard moves few of the others' slots.  A row is placed by one
hash and one lookup.

The table is made from the shard names alone: ``size`` steps on the driver,
bounded by ``MAX_SLOTS``.  It travels as a binary literal and is
broadcast as ``size`` rows, so placing rows needs no shuffle at any input size.

Defined results: a null key is placed like the empty string; equal keys share a
slot; an empty table gives no rows; an input column called ``slot`` or
``shard`` is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import add, any_names, hash52, unused

MAX_SLOTS = 1 << 20  # bound of what is broadcast: 16 MB
SHARDS, SLOTS = 64, 6553  # production parameters: 100 slots a shard and more


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def _seed(name: str, what: str, modulus: int) -> int:
    return int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:13], 16) % modulus


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The shard number of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, one at least")
    if not _prime(size) or size < len(shards) or size > MAX_SLOTS:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MAX_SLOTS}")
    pref = [(_seed(s, "offset", size), 1 + _seed(s, "skip", size - 1)) for s in shards]
    at, owner, free = [0] * len(shards), [-1] * size, size
    while free:
        for i, (offset, skip) in enumerate(pref):
            while owner[slot := (offset + at[i] * skip) % size] >= 0:
                at[i] += 1
            owner[slot] = i
            at[i] += 1
            free -= 1
            if not free:
                break
    return owner


def slots_frame(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """``slot, shard`` (shard: the number of the shard), ``size`` rows."""
    packed = bytearray(b"".join(x.to_bytes(4, "big") for x in lookup_table(shards, size)))
    number = F.conv(F.hex(F.substring(F.lit(packed), (F.col("id") * 4 + 1).cast("int"), F.lit(4))), 16, 10)
    return spark.range(size).select(F.col("id").alias("slot"), number.cast("int").alias("shard"))


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


@any_names
def place(df: DataFrame, key: Column, shards: list[str], size: int) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of each row, by one broadcast join."""
    k, s = unused(df, "slot", "slots")
    table = slots_frame(df.sparkSession, shards, size)
    keyed = df.withColumn(k, F.pmod(hash52(key), F.lit(size)))
    out = keyed.join(F.broadcast(table.select(F.col("slot").alias(k), F.col("shard").alias(s))), k)
    return add(out, slot=out[k], shard=out[s]).drop(k, s)
