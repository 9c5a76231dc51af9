"""Bracketed units of work: from an opening event to the closing one that confirms it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.event_log import keep
from .intervals import BUCKET
from .scan import SLOT, nearby, running, slotted


def _reaching(df: DataFrame, key: str, ts: str, opens: Column, closes: Column, behind: int) -> DataFrame:
    """Times, openings and closes within ranges; a log of ``sources.layout`` has its ranges and isn't shuffled again."""
    d = df.select(key, ts, F.when(opens, F.col(ts)).alias("_open"), closes.alias("_close"), *[c for c in (SLOT, "_own") if SLOT in df.columns])
    return d if SLOT in df.columns else nearby(d, [key], ts, behind)


def bracket_pairs(
    df: DataFrame, key: str, ts: str, opens: Column, closes: Column, max_unit: int, min_unit: int, use_opens: bool = True
) -> DataFrame:
    """``key, start_ts, end_ts, has_open``: one unit per closing event.

    A unit begins at the last opening strictly before its close, if that lies after the close before and
    within ``max_unit``; else at the first event of that reach.  Units shorter than ``min_unit`` are dropped,
    but still end the reach of the next one.  Two range windows and a lag; no loop.

    Nothing older than ``max_unit`` can matter to a close, so windows run within time ranges that see that far back.
    """
    order = Window.partitionBy(SLOT).orderBy(ts)
    rows = _reaching(df, key, ts, opens, closes, max_unit).withColumns({
        "_last_open": F.max("_open").over(order.rangeBetween(Window.unboundedPreceding, -1)),
        "_first": F.min(ts).over(order.rangeBetween(-max_unit, 0)),
    })
    done = rows.where("_close").withColumn("_prev", F.lag(ts).over(order)).where("_own")
    reach = F.greatest(F.col("_prev"), F.col(ts) - max_unit)  # of a close without a close before, ts - max_unit
    good = F.lit(use_opens) & (F.col("_last_open") >= reach)
    start = F.when(good, F.col("_last_open")).otherwise(F.greatest("_prev", "_first"))
    units = done.select(key, start.alias("start_ts"), F.col(ts).alias("end_ts"), F.coalesce(good, F.lit(False)).alias("has_open"))
    return units.where(F.col("end_ts") - F.col("start_ts") >= min_unit)


def bracket_settings(df: DataFrame, key: str, ts: str, opens: Column, closes: Column, settings: list[dict], min_unit: int) -> DataFrame:
    """``key, setting, cap, start_ts, end_ts``: the units of ``bracket_pairs`` under several settings, in one pass.

    A setting is a dict of name, reach, opens (whether openings count) and cap; windows are computed once, the first
    event of a reach once a reach, and settings part at the closing events only.
    """
    reaches = sorted({s["reach"] for s in settings})
    order = Window.partitionBy(SLOT).orderBy(ts)
    rows = _reaching(df, key, ts, opens, closes, max(reaches)).withColumns(
        {"_last_open": F.max("_open").over(order.rangeBetween(Window.unboundedPreceding, -1))} | {f"_f{i}": F.min(ts).over(order.rangeBetween(-r, 0)) for i, r in enumerate(reaches)}
    )
    done = rows.where("_close").withColumn("_prev", F.lag(ts).over(order)).where("_own")
    each = []
    for s in settings:
        good = F.lit(s["opens"]) & (F.col("_last_open") >= F.greatest(F.col("_prev"), F.col(ts) - s["reach"]))
        start = F.when(good, F.col("_last_open")).otherwise(F.greatest("_prev", f"_f{reaches.index(s['reach'])}"))
        each.append(F.struct(F.lit(s["name"]).alias("setting"), F.lit(s["cap"]).cast("bigint").alias("cap"), start.alias("start_ts")))
    u = done.select(key, F.col(ts).alias("end_ts"), F.explode(F.array(*each)).alias("s")).select(key, "s.*", "end_ts")
    return u.where(F.col("end_ts") - F.col("start_ts") >= min_unit)


def expand(units: DataFrame, bounds: DataFrame, key: str, cap: int | Column, width: int = BUCKET, large: DataFrame | None | str = "count") -> DataFrame:
    """Widens each unit by half the gap to its neighbours (session bounds at the edges), ``cap`` at most."""
    units = units if large is None else keep(units, "units")
    near = running(slotted(units, [key], "start_ts", width, large), ["start_ts", "end_ts"], before={"_pe": F.col("end_ts")}, beyond={"_ns": F.col("start_ts")})
    u, most = near.join(bounds, key), cap if isinstance(cap, Column) else F.lit(cap)
    back = (F.col("start_ts") - F.coalesce("_pe", "t0")) / 2
    ahead = (F.coalesce("_ns", "t1") - F.col("end_ts")) / 2
    u = u.withColumn("_b", F.greatest(F.lit(0), F.least(F.floor(back), most)))
    u = u.withColumn("_a", F.greatest(F.lit(0), F.least(F.floor(ahead), most)))
    return u.select(key, "start_ts", "end_ts", (F.col("start_ts") - F.col("_b")).alias("wide_start"), (F.col("end_ts") + F.col("_a")).alias("wide_end"))


def bounds(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"))
