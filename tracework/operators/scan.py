"""Running values along a key of any size: a segmented scan.

Keys of up to ``MOST`` rows are one window partition each.  A larger key is cut into time ranges: each (key, range) is a
window partition; what a range hands on (its last or first value, its sum) is aggregated first, carried over the ranges
of the key by a scan of one row a range, and joined to the rows of the others.  A key that holds most rows is thus as
many tasks as it has ranges, and rows are shuffled once.  A count of rows a key tells beforehand which ones are large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BUCKET

#: Column of the range of a row: a struct, so that null keys and times form ranges of their own.
SLOT = "_slot"
#: Rows of a key that are one partition, and the most keys that are cut (they are broadcast): the largest ones.
MOST, CUT = 10_000, 100_000
#: The range of rows without a time.
NEVER = -(1 << 62)


def large_keys(df: DataFrame, keys, most: int = MOST) -> DataFrame | None:
    """The keys of more than ``most`` rows (of very many the largest), or nothing if there are none; it counts rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    top = counts.agg(F.max("_n").alias("top"), F.sum("_n").alias("total")).first()
    if (top["top"] or 0) <= most:
        return None
    return counts.where(F.col("_n") > max(most, top["total"] // CUT)).select(*keys)


def slotted(df: DataFrame, keys, ts: str | Column, width: int = BUCKET, large: DataFrame | None | str = "count") -> DataFrame:
    """``df`` with the range of each row.  Keys of ``large`` are cut; by default those are counted in ``df``."""
    names = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    if isinstance(large, str):
        large = large_keys(df, keys)
    if large is None:
        return df.withColumn(SLOT, F.struct(*names))
    holds = F.lit(True)
    for k in large.columns:
        holds &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    at = F.col(ts) if isinstance(ts, str) else ts
    part = F.when(F.col("_cut"), F.coalesce(F.floor(at / width), F.lit(NEVER)))
    cut = large.select(*[F.col(k).alias(f"_k_{k}") for k in large.columns], F.lit(True).alias("_cut"))
    d = df.join(F.broadcast(cut), holds, "left")  # ``CUT`` keys at most
    return d.withColumn(SLOT, F.struct(part.alias("part"), *names)).drop("_cut", *[f"_k_{k}" for k in large.columns])


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running(df: DataFrame, order, *, last=None, before=None, after=None, beyond=None, earlier=None, total=None, reverse=None, back=None) -> DataFrame:
    """Adds columns to ``df`` of ``slotted``, whose ``order`` begins with the time; each argument maps names to values.

    ``last``: the last value that is not null up to the row; ``before``: the same without the row; ``after`` and
    ``beyond``: the first one from the row on, and behind it; ``earlier``: the greatest value at an earlier time;
    ``total``: the sum up to the row.  ``reverse`` is the order for looking ahead and ``back`` the ascending one that
    says which value of a range it meets last, if they aren't ``order`` turned round.
    """
    kinds = {"last": last or {}, "before": before or {}, "after": after or {}, "beyond": beyond or {}, "earlier": earlier or {}, "total": total or {}}
    order = [_column(c) for c in order]
    d = df.withColumns({f"_v_{n}": v for values in kinds.values() for n, v in values.items()})
    parts = [f.name for f in d.schema[SLOT].dataType.fields]
    fields = [f"{SLOT}.{name}" for name in parts if name != "part"]
    known = lambda n, at: F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(at)]))

    states, carried = [], []
    ahead = Window.partitionBy(*fields).orderBy(f"{SLOT}.part").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*fields).orderBy(F.desc(f"{SLOT}.part")).rowsBetween(Window.unboundedPreceding, -1)
    for kind, values in kinds.items():
        for n in values:
            v, c = F.col(f"_v_{n}"), F.col(f"_c_{n}")
            if kind in ("last", "before"):
                states.append(F.max_by(v, known(n, order)).alias(f"_c_{n}"))
                carried.append(F.last(c, True).over(ahead).alias(f"_c_{n}"))
            elif kind in ("after", "beyond"):
                states.append(F.min_by(v, known(n, back or order)).alias(f"_c_{n}"))
                carried.append(F.last(c, True).over(behind).alias(f"_c_{n}"))
            elif kind == "earlier":
                states.append(F.max(v).alias(f"_c_{n}"))
                carried.append(F.max(c).over(ahead).alias(f"_c_{n}"))
            else:
                states.append(F.sum(v).alias(f"_c_{n}"))
                carried.append(F.sum(c).over(ahead).alias(f"_c_{n}"))

    to_here = Window.partitionBy(SLOT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    up_to = Window.partitionBy(SLOT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turned = reverse or [c.desc() for c in order]
    from_here = Window.partitionBy(SLOT).orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0)
    from_next = Window.partitionBy(SLOT).orderBy(*turned).rowsBetween(Window.unboundedPreceding, -1)
    by_time = Window.partitionBy(SLOT).orderBy(order[0]).rangeBetween(Window.unboundedPreceding, -1)
    windows = {"last": to_here, "before": up_to, "after": from_here, "beyond": from_next, "earlier": by_time, "total": to_here}
    inside = {}
    for kind, values in kinds.items():
        for n in values:
            v = F.col(f"_v_{n}")
            f = F.max(v) if kind == "earlier" else F.sum(v) if kind == "total" else F.last(v, True)
            inside[f"_i_{n}"] = f.over(windows[kind])
    names = [n for values in kinds.values() for n in values]
    rows = d.withColumns(inside)
    if "part" not in parts:
        return rows.withColumns({n: F.col(f"_i_{n}") for n in names}).drop(*[f"{p}_{n}" for n in names for p in ("_v", "_i")])
    carry = d.where(F.col(f"{SLOT}.part").isNotNull()).groupBy(SLOT).agg(*states).select(SLOT, *carried)
    rows = rows.join(carry, SLOT, "left")
    add = lambda n: F.coalesce(F.col(f"_i_{n}") + F.col(f"_c_{n}"), F.col(f"_i_{n}"), F.col(f"_c_{n}"))
    out = {n: add(n) if kind == "total" else F.coalesce(f"_i_{n}", f"_c_{n}") for kind, values in kinds.items() for n in values}
    return rows.withColumns(out).drop(*[f"{p}_{n}" for n in names for p in ("_v", "_i", "_c")])


def nearby(df: DataFrame, keys, ts: str, behind: int, least: int = BUCKET) -> DataFrame:
    """Rows once in their own time range and once in the next one if that has to see them: the range, and whether it is ``_own``.

    A range sees ``behind`` time before its start, which suffices for windows that reach no farther back; ranges are
    four times as long as that at least, so few rows are doubled.  Nothing is carried, so ``df`` is read once.
    """
    width = max(4 * behind, least)
    at = F.col(ts)
    parts = F.coalesce(F.sequence(F.floor(at / width), F.floor((at + behind) / width)), F.array(F.lit(None).cast("bigint")))
    d = df.withColumn("_part", F.explode(parts)).withColumn("_own", F.coalesce(F.col("_part") == F.floor(at / width), F.lit(True)))
    return d.withColumn(SLOT, F.struct(F.col("_part").alias("part"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])).drop("_part")
