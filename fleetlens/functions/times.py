"""Time-zone independent conversions between ``timestamp_ntz`` and zoned
timestamps.

A plain cast between the two reads the wall clock in the session time zone,
which shifts epoch-aligned windows in zones with odd offsets and can reorder
events around a daylight-saving gap.  Going through epoch microseconds treats
the wall clock as UTC whatever the session says.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_micros(col: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {NTZ_EPOCH}, `{col}`)")


def ntz_to_instant(col: str) -> Column:
    """``timestamp_ntz`` column -> ``timestamp`` with the same UTC wall clock."""
    return F.timestamp_micros(ntz_micros(col))


def instant_to_ntz(col: str) -> Column:
    """``timestamp`` column -> ``timestamp_ntz`` holding its UTC wall clock."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(`{col}`), {NTZ_EPOCH})")
