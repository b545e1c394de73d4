"""A1 / A2: first-wins and last-wins resolution of a key.

First-wins is the exclusive-create rule of artifact collection: the first
artifact (in task order) to claim a destination keeps it; later ones are
reported, not written.  Last-wins is the relocation rule: an existing
destination is replaced, so the last mover keeps it.

``dropDuplicates`` has no defined winner, so neither uses it; both return every
input row with a ``kept`` flag, computed skew-safe (``plans.skew``): a hot key
is split over several tasks, never one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetlens.plans.skew import flag_extreme


def first_wins(df: DataFrame, key, order, kept: str = "kept") -> DataFrame:
    """Every row plus ``kept``: true for the first row of each ``key`` by
    ``order`` (ascending, total within a key)."""
    return flag_extreme(df, list(key), list(order), first=True, flag=kept)


def last_wins(df: DataFrame, key, order, kept: str = "kept") -> DataFrame:
    """Every row plus ``kept``: true for the last row of each ``key`` by
    ``order`` (ascending, total within a key)."""
    return flag_extreme(df, list(key), list(order), first=False, flag=kept)
