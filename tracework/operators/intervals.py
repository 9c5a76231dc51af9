"""Interval joins: session and time bucket are equalities, the range a residual, so that neither a nested
loop is planned nor a long session meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default width of a bucket: a day in microseconds.
BUCKET = 86_400_000_000


def _bucket(ts: str | Column, width: int) -> Column:
    return F.floor((F.col(ts) if isinstance(ts, str) else ts) / width)


def _spread(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row per bucket that an interval touches."""
    first, last = _bucket(start, width), _bucket(end, width)
    return df.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def containment(units: DataFrame, events: DataFrame, key: str, ts: str, width: int = BUCKET, how: str = "left") -> DataFrame:
    """Units with the events in ``[start_ts, end_ts]``, both ends included.

    With ``how="left"`` the parts of a unit (one a bucket) that hold no event stay, as a row without one: count
    the columns of the event, not rows.
    """
    e = events.withColumnRenamed(key, "_key").withColumn("_at", _bucket(ts, width))
    holds = (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_at")) & F.col(ts).between(F.col("start_ts"), F.col("end_ts"))
    return _spread(units, "start_ts", "end_ts", width).join(e, holds, how).drop("_key", "_bucket", "_at")


def overlaps(gold: DataFrame, pred: DataFrame, key: str, width: int = BUCKET) -> DataFrame:
    """Pairs that share time, with ``overlap``; columns gs, ge, ps, pe.  A pair is found in the bucket where it begins."""
    g = _spread(gold.select(key, F.col("start_ts").alias("gs"), F.col("end_ts").alias("ge")), "gs", "ge", width)
    p = _spread(pred.select(F.col(key).alias("_key"), F.col("start_ts").alias("ps"), F.col("end_ts").alias("pe")), "ps", "pe", width)
    p = p.withColumnRenamed("_bucket", "_at")
    holds = (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_at")) & (F.col("ps") < F.col("ge")) & (F.col("pe") > F.col("gs"))
    both = g.join(p, holds).where(F.col("_bucket") == _bucket(F.greatest("gs", "ps"), width)).drop("_key", "_bucket", "_at")
    return both.withColumn("overlap", F.least("ge", "pe") - F.greatest("gs", "ps"))


def best_overlap(pairs: DataFrame, key: str) -> DataFrame:
    """For each gold unit the predicted one that shares most time, the earlier on a tie."""
    best = F.max_by(F.struct("ps", "pe", "overlap"), F.struct("overlap", (-F.col("ps")).alias("a"), (-F.col("pe")).alias("b"))).alias("_b")
    return pairs.groupBy(key, "gs", "ge").agg(best).select(key, "gs", "ge", "_b.ps", "_b.pe", "_b.overlap")
