"""Greedy suppression of neighbouring candidates, in rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.event_log import keep

#: Gaps in a time range.
REACH = 1024


def settle(at: np.ndarray, score: np.ndarray, kept: np.ndarray, own: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates are kept and which struck, as far as the rows at hand can tell.

    By falling score (the earlier on a tie): one is struck if a kept one is nearer than ``gap``, and kept if it is of
    this range's own and no better one near it is still open.
    """
    order = np.argsort(at, kind="stable")
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    low, high = np.searchsorted(at[order], at - gap, "right"), np.searchsorted(at[order], at + gap, "left")
    is_kept, waits = kept[order].copy(), np.zeros(len(at), bool)
    out, struck = kept.copy(), np.zeros(len(at), bool)
    for i in np.lexsort((at, -score)):
        if kept[i]:
            continue
        near = slice(low[i], high[i])
        if is_kept[near].any():
            struck[i] = True
        elif own[i] and not waits[near].any():
            is_kept[place[i]] = out[i] = True
        else:
            waits[place[i]] = True
    return out, struck


def non_max(df: DataFrame, key: str, ts: str, score: str, gap: int, reach: int = REACH) -> DataFrame:
    """``key, ts``: candidates by falling score (the earlier on a tie), each kept if no kept one is nearer
    than ``gap``.  Rows with a null time or score are no candidates; repeated times count once.

    Each round settles the candidates of every time range of ``reach`` gaps as far as its own rows and those within
    ``gap`` of it can tell, and the next round shifts the ranges by half, until none is open.  A chain of falling
    scores that runs through many ranges takes a round a range; no key and no chain comes together in a task.
    """
    width = max(2, reach * gap)
    c = df.where(F.col(ts).isNotNull() & F.col(score).isNotNull()).groupBy(key, ts).agg(F.max(F.col(score).cast("double")).alias("_score"))
    c = c.withColumn("_kept", F.lit(False))
    schema = c.schema

    def resolve(table: pa.Table) -> pa.Table:
        kept, struck = settle(*[table[c].to_numpy() for c in (ts, "_score", "_kept", "_own")], gap)
        table = table.set_column(table.schema.get_field_index("_kept"), "_kept", pa.array(kept))
        return table.filter(pc.and_(table["_own"], pa.array(~struck))).select(schema.names)

    turn = 0
    while True:
        at = F.col(ts) + (turn % 2) * (width // 2)
        parts = F.sequence(F.floor((at - (gap - 1)) / width), F.floor((at + (gap - 1)) / width))
        rows = c.withColumn("_part", F.explode(parts)).withColumn("_own", F.col("_part") == F.floor(at / width))
        c = keep(rows.groupBy(key, "_part").applyInArrow(resolve, schema), "candidates")
        if c.where("not _kept").isEmpty():
            return c.select(key, ts)
        turn += 1
