"""Ordered-event operators: islands, fills and as-of lookups as segmented scans.

Every ordering takes explicit tie-break columns; each operator shuffles its rows once, by key and time range, so that a
key of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import BUCKET
from .scan import SLOT, running, slotted


def _numbered(d: DataFrame, order, starts: Column, name: str) -> DataFrame:
    flag = F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    d = running(d.withColumn("_flag", flag), order, total={name: F.col("_flag")})
    return d.withColumn(name, (F.col(name) + 1).cast("bigint")).drop("_flag", SLOT)


def islands(df: DataFrame, keys, order, starts: Column, name: str = "island", width: int = BUCKET) -> DataFrame:
    """Numbers runs from 1: a row where ``starts`` holds (null counts as false) begins a new one."""
    return _numbered(slotted(df, keys, order[0], width), order, starts, name)


def gap_sessions(df: DataFrame, keys, ts: str, gap: int, ties=(), width: int = BUCKET) -> DataFrame:
    """A new group begins where the time since the row before exceeds ``gap`` (equal stays together)."""
    order = [ts, *ties]
    d = running(slotted(df, keys, ts, width), order, before={"_prev": F.col(ts)})
    return _numbered(d, order, F.col(ts) - F.col("_prev") > gap, "group_no").drop("_prev")


def change_runs(df: DataFrame, keys, order, value: str, width: int = BUCKET) -> DataFrame:
    """A new group begins where ``value`` differs from the last value that is not null; nulls never begin one."""
    d = running(slotted(df, keys, order[0], width), order, before={"_prev": F.col(value)})
    return _numbered(d, order, F.col(value) != F.col("_prev"), "group_no").drop("_prev")


def fill(df: DataFrame, keys, order, value: str, name: str, width: int = BUCKET) -> DataFrame:
    """Forward fill; rows before the first value take that first value."""
    d = running(slotted(df, keys, order[0], width), order, last={"_fwd": F.col(value)}, after={"_bwd": F.col(value)})
    return d.withColumn(name, F.coalesce("_fwd", "_bwd")).drop("_fwd", "_bwd", SLOT)


def neighbours(df: DataFrame, keys, ts: str, is_target: Column, ties=(), width: int = BUCKET) -> DataFrame:
    """Adds the times of the nearest targets: ``before`` (up to this row), ``strictly_before`` (earlier
    time) and ``after`` (from this row on)."""
    at = F.when(is_target, F.col(ts))
    d = running(slotted(df, keys, ts, width), [ts, *ties], last={"before": at}, earlier={"strictly_before": at}, after={"after": at})
    return d.drop(SLOT)


def nearest(ts: Column, before: Column, after: Column, most: int) -> Column:
    """The nearer of two neighbours, the earlier on a tie, none farther than ``most``."""
    near = F.when(before.isNull(), after).when(after.isNull(), before).when(ts - before <= after - ts, before).otherwise(after)
    return F.when(F.abs(near - ts) <= most, near)
