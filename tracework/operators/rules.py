"""Threshold rules and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audits import linear_quantiles


def route(amount: Column, rules: list[tuple[int, str, str]]) -> Column:
    """Outcome for an amount: rules (bound, comparison, outcome) ascending; a lower bound that holds
    overwrites, an upper bound that holds only fills; null if none holds."""
    hit = F.lit(None).cast("string")
    for bound, compare, outcome in sorted(rules, key=lambda r: r[0]):
        holds = {">=": amount >= bound, ">": amount > bound, "<": amount < bound, "<=": amount <= bound}[compare]
        hit = F.when(holds & (F.lit(compare[0] == ">") | hit.isNull()), F.lit(outcome)).otherwise(hit)
    return hit


def profile(df: DataFrame, label: str, value: str) -> DataFrame:
    """Per label: n, median, interquartile range, coefficient of variation (half-even), share of the total."""
    p = df.groupBy(label).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.bround(F.stddev_samp(value) / F.avg(value), 2).alias("cv")
    )
    q = linear_quantiles(df, label, value, {"median": 0.5, "low": 0.25, "high": 0.75}).withColumnRenamed(label, "_label")
    p = p.join(q, F.col(label).eqNullSafe(F.col("_label")), "left")
    p = p.select(label, "n", "total", "median", (F.col("high") - F.col("low")).alias("iqr"), "cv")
    return p.withColumn("share_pct", F.round(100.0 * F.col("total") / F.sum("total").over(Window.partitionBy()), 4))  # one row a label


def majority(df: DataFrame, key: str, value: str, support: int, unanimous: bool = False) -> DataFrame:
    """``key -> value`` by most votes (ties to the smaller value), with ``support`` votes at least."""
    votes = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(key)
    ranked = votes.withColumn("_n", F.row_number().over(w.orderBy(F.desc("votes"), value))).withColumn("_k", F.count("*").over(w))
    good = (F.col("_n") == 1) & (F.col("votes") >= support)
    return ranked.where(good & (F.col("_k") == 1) if unanimous else good).select(key, value, "votes")
