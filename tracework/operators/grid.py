"""As-of lookups against another table, and scores on time bins without building the bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BUCKET
from .scan import running, slotted

def asof(df: DataFrame, key: str, ts: str, targets: DataFrame, at: str, value: str, width: int = BUCKET, large: DataFrame | None | str = "count") -> DataFrame:
    """Adds ``before`` and ``after``: structs (at, value) of the nearest targets up to ``ts`` and from it on.

    One union and one shuffle on key and time range; what lies beyond a range is carried (see ``scan``).
    """
    hit = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    right = targets.select(key, F.col(at).alias("_t"), hit.alias("_hit"))
    left = df.select(key, F.col(ts).alias("_t"), F.struct(*[f"`{c}`" for c in df.columns]).alias("_row"))
    both = slotted(left.unionByName(right, allowMissingColumns=True), [key], "_t", width, large)
    is_row = F.col("_row").isNotNull()
    turned = [F.desc("_t"), is_row, F.desc("_hit")]
    found = running(both, ["_t", is_row, "_hit"], last={"before": F.col("_hit")}, after={"after": F.col("_hit")}, reverse=turned, back=[F.col("_t"), F.col("_hit")])
    return found.where(is_row).select("_row.*", "before", "after")


def nearer(ts: Column, most: int) -> Column:
    """Of ``before`` and ``after`` the nearer one, the earlier on a tie; null beyond ``most``."""
    b, a = F.col("before"), F.col("after")
    near = F.when(b.isNull(), a).when(a.isNull(), b).when(ts - b["at"] <= a["at"] - ts, b).otherwise(a)
    return F.when(F.abs(near["at"] - ts) <= most, near)


def grid(bounds: DataFrame, key: str, step: int) -> DataFrame:
    """``key, g``: points from t0 to the first one not before t1."""
    last = F.col("t0") + F.ceil((F.col("t1") - F.col("t0")) / step) * step
    return bounds.select(key, F.explode(F.sequence("t0", last, F.lit(step))).alias("g"))


def grid_units(bounds: DataFrame, anchors: DataFrame, structural: DataFrame, key: str, step: int, most: int, snap: int) -> DataFrame:
    """``key, start_ts, end_ts, label``: each grid point takes the label of its nearest anchor within ``most``;
    runs of one label become units, whose edges snap to structural times within ``snap``.

    ``anchors(key, at, value)``, ``structural(key, at, value)``.  A key without anchors gives no unit; a unit
    that snapping leaves without length is dropped.
    """
    points = asof(grid(bounds, key, step), key, "g", anchors, "at", "value")
    points = points.select(key, "g", nearer(F.col("g"), most)["value"].alias("label"))
    w = Window.partitionBy(key).orderBy("g")
    lag = F.lag(F.struct("label")).over(w)
    first = lag.isNull() | ~F.col("label").eqNullSafe(lag["label"])
    runs = points.withColumn("_first", first).withColumn("_last", F.max("g").over(Window.partitionBy(key))).where("_first")
    runs = runs.select(key, "label", F.col("g").alias("_s"), F.coalesce(F.lead("g").over(w), F.col("_last")).alias("_e"))
    units = runs.where("label is not null")
    for edge, name in (("_s", "start_ts"), ("_e", "end_ts")):
        near = asof(units, key, edge, structural, "at", "value")
        snapped = F.coalesce(nearer(F.col(edge), snap)["at"], F.col(edge)).alias(name)
        units = near.select(*[c for c in units.columns], snapped)
    return units.where("end_ts > start_ts").select(key, "start_ts", "end_ts", "label")


def timeline(units: DataFrame, bounds: DataFrame, key: str, label: str, step: int) -> DataFrame:
    """``key, bin, label`` of the covered bins; where units share a bin, the later one counts."""
    at = lambda c: (F.col(c) - F.col("t0")) / step
    n = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / step))
    u = units.join(bounds, key).withColumn("_a", F.greatest(F.lit(0), F.floor(at("start_ts")))).withColumn("_b", F.least(n, F.ceil(at("end_ts"))))
    bins = u.where("_b > _a").withColumn("bin", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)))
    return bins.groupBy(key, "bin").agg(F.max_by(label, F.struct("start_ts", "end_ts")).alias(label))


def window_diff(gold: DataFrame, pred: DataFrame, bounds: DataFrame, key: str, step: int) -> DataFrame:
    """``key, n, k, window_diff``: share of windows of k bins with unequal numbers of boundaries.

    ``gold`` and ``pred`` hold distinct (key, bin) inside (0, n).  A boundary at x lies in the windows that
    begin at x - k + 1 to x, so the difference is a sum of steps; runs between steps are weighed by length.
    """
    both = gold.select(key, "bin", F.lit(1).alias("_d")).unionByName(pred.select(key, "bin", F.lit(-1).alias("_d")))
    size = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / step)).cast("bigint")
    counts = both.groupBy(key).agg(F.count_if(F.col("_d") == 1).alias("_g"), F.sum("_d").alias("_total"))
    s = bounds.select(key, size.alias("n")).join(counts, key, "left").na.fill(0, ["_g", "_total"])
    s = s.withColumn("k", F.greatest(F.lit(2), F.bround(F.col("n") / (2 * F.greatest(F.lit(1), F.col("_g"))))).cast("bigint"))
    s = s.select(key, "n", "k", "_total", (F.col("n") - F.col("k") + 1).alias("_stop"))
    edge = lambda at, d: F.struct(at.cast("bigint").alias("at"), d.cast("bigint").alias("d"))
    steps = F.array(edge(F.col("bin") - F.col("k") + 1, F.col("_d")), edge(F.col("bin") + 1, -F.col("_d")))
    rows = s.join(both, key).select(key, "n", "k", "_total", "_stop", F.explode(steps).alias("_x"))
    rows = rows.unionByName(s.select(key, "n", "k", "_total", "_stop", edge(F.lit(0), F.lit(0)).alias("_x")))
    at = F.greatest(F.lit(0), F.least(F.col("_x.at"), F.col("_stop")))
    rows = rows.groupBy(key, "n", "k", "_total", "_stop", at.alias("_at")).agg(F.sum("_x.d").alias("_d"))
    w = Window.partitionBy(key).orderBy("_at")
    rows = rows.withColumn("_run", F.sum("_d").over(w)).withColumn("_len", F.lead("_at").over(w))
    rows = rows.withColumn("_len", F.coalesce("_len", "_stop") - F.col("_at"))
    bad = F.sum(F.when(F.col("_run") != 0, F.col("_len")).otherwise(0)) / F.first("_stop")
    short = F.when(F.first("_total") != 0, 1.0).otherwise(0.0)
    return rows.groupBy(key, "n", "k").agg(F.round(F.when(F.col("n") <= F.col("k"), short).otherwise(bad), 6).alias("window_diff"))
