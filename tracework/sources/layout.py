"""Logs laid out for reuse: written once by key and time range, so that windows on them need no shuffle.

A table is bucketed by the range of a row (key and stretch of time) and sorted within it; rows that the next range has to
see are stored in both.  A key of any size is thus spread over as many buckets as it has ranges, and each operator that
looks no farther back than the layout does reads its buckets as they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.scan import SLOT, nearby
from .event_log import scratch

_PROPERTY = "tracework.layout"


def _layout(keys: list[str], ts: str) -> str:
    return "/".join([*keys, ts])


def lay_out(df: DataFrame, name: str, keys: list[str], ts: str, behind: int, buckets: int, path: str | None = None) -> None:
    """Writes ``df`` as the table ``name`` (a new one) for windows that reach ``behind`` back in ``ts`` at most.

    Each bucket is one file; ``buckets`` should grow with the log (files of a few hundred MB).  ``path`` defaults to a fresh
    folder in the shared one.  Rows with a null key or time form ranges of their own; an empty table is stored empty.
    """
    spark = df.sparkSession
    rows = nearby(df, keys, ts, behind).repartition(buckets, SLOT)  # the hash of a bucket: a task writes one
    rows.write.bucketBy(buckets, SLOT).sortBy(SLOT, ts).option("path", path or scratch(spark, name)).saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_PROPERTY}' = '{_layout(keys, ts)}', '{_PROPERTY}.behind' = '{behind}')")


def laid_out(spark: SparkSession, name: str, keys: list[str], ts: str, behind: int) -> DataFrame:
    """The rows of a table of ``lay_out``, with their ranges; an error if it was laid out otherwise or sees less far back."""
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if found.get(_PROPERTY) != _layout(keys, ts) or int(found.get(f"{_PROPERTY}.behind", -1)) < behind:
        raise ValueError(f"{name} isn't laid out for windows of {behind} by {_layout(keys, ts)}")
    return spark.table(name)


def whole(df: DataFrame) -> DataFrame:
    """The log itself out of ``laid_out``: each row once."""
    return df.where("_own").drop(SLOT, "_own")
