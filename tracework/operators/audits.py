"""Checks of results: randomisation tests, purity, quantiles by list index, dominant identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def randomisation_test(df: DataFrame, ident: str, value: str, group: Column, draws: int) -> DataFrame:
    """One row: observed difference of the means of ``value`` in and out of ``group``, draws at least as
    far from 0, and (hits + 1) / (draws + 1).

    In draw d a row is in the group if a hash of d and its id says so, with the group's share as
    probability; all draws are counted in one pass with map-side sums, whatever the number of rows.
    """
    d = df.select(F.col(ident).cast("string").alias("_i"), F.col(value).cast("double").alias("_v"), group.alias("_g")).where("_v is not null and _g is not null")
    share = d.agg(F.count_if("_g").alias("_n"), F.count("*").alias("_all"))  # one row
    u = F.conv(F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit("-"), F.col("_i")).cast("binary")), 1, 7), 16, 10).cast("bigint")
    rows = d.crossJoin(F.broadcast(share)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    inside = F.when(F.col("draw") == 0, F.col("_g")).otherwise(u * F.col("_all") < F.col("_n") * 2**28)
    rows = rows.withColumn("_in", inside)
    stat = F.avg(F.when(F.col("_in"), F.col("_v"))) - F.avg(F.when(~F.col("_in"), F.col("_v")))
    stats = rows.groupBy("draw").agg(stat.alias("stat"))
    seen = F.max(F.when(F.col("draw") == 0, F.col("stat")))
    out = stats.agg(seen.alias("_seen"), F.collect_list(F.when(F.col("draw") > 0, F.col("stat"))).alias("_s"))
    hits = F.size(F.filter("_s", lambda s: F.abs(s) >= F.abs(F.col("_seen")) - 1e-12))
    return out.select(F.round("_seen", 6).alias("observed"), hits.cast("bigint").alias("hits"), F.round((hits + 1) / (draws + 1), 6).alias("p"))


def permutation_tests(df: DataFrame, group: str, value: str, draws: int = 5000, seed: int = 0, parts: int = 16) -> DataFrame:
    """``group, n, observed, hits, p, p_corrected``: one test a group, of the difference between the mean of ``value``
    inside and outside of it, against permutations of the values.

    A permutation deals the distinct values with their counts, so rows are counted first and each draw is one of
    a multivariate hypergeometric distribution; draws run in parts.  The counts (distinct values and groups) must
    be few: they go into each task.  p is (hits + 1) / (draws + 1), the correction Bonferroni's.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = rows.groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).count().collect()
    values = sorted({r.v for r in counts})
    total = {v: sum(r["count"] for r in counts if r.v == v) for v in values}
    tests = sorted({r.g for r in counts})
    own = {g: {r.v: r["count"] for r in counts if r.g == g} for g in tests}
    size, everything = sum(total.values()), sum(v * n for v, n in total.items())
    tests = [g for g in tests if 0 < sum(own[g].values()) < size]
    spark = df.sparkSession

    def difference(inside, n):
        return inside / n - (everything - inside) / (size - n)

    def draw(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for part in batch["id"]:
                rng, here = np.random.default_rng([seed, int(part)]), len(range(int(part), draws, parts))
                for i, g in enumerate(tests):
                    n = sum(own[g].values())
                    seen = abs(difference(sum(v * c for v, c in own[g].items()), n)) - 1e-12
                    dealt = rng.multivariate_hypergeometric([total[v] for v in values], n, size=here, method="marginals")
                    yield pd.DataFrame({"i": [i], "hits": [int((np.abs(difference(dealt @ np.array(values), n)) >= seen).sum())]})

    hits = spark.range(0, parts, 1, parts).mapInPandas(draw, "i int, hits bigint").groupBy("i").agg(F.sum("hits").alias("hits"))
    facts = [(i, g, sum(own[g].values()), float(difference(sum(v * c for v, c in own[g].items()), sum(own[g].values())))) for i, g in enumerate(tests)]
    named = spark.createDataFrame(facts, f"i int, `{group}` {rows.schema[group].dataType.simpleString()}, n bigint, observed double")
    p = (F.col("hits") + 1) / (draws + 1)
    return named.join(hits, "i").select(group, "n", F.round("observed", 6).alias("observed"), "hits", F.round(p, 6).alias("p"), F.round(F.least(F.lit(1.0), p * max(1, len(tests))), 6).alias("p_corrected"))


def accepted(df: DataFrame, bar: dict[str, Column]) -> DataFrame:
    """``name, ok, accepted`` of named comparisons on a table of one row; accepted if all hold."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), c.alias("ok")) for k, c in bar.items()])
    return df.select(rows.alias("_r")).withColumn("accepted", F.forall("_r", lambda r: r["ok"])).select(F.explode("_r").alias("r"), "accepted").select("r.name", "r.ok", "accepted")


def purity(df: DataFrame, label: str, other: str) -> DataFrame:
    """``label, top, votes, total, share, purity``: per label its most frequent ``other`` (the smaller on a tie) and that one's share."""
    n = df.groupBy(label, other).agg(F.count("*").alias("n"))
    w = Window.partitionBy(label)
    n = n.withColumn("total", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), other)))
    return n.where("_r = 1").select(label, F.col(other).alias("top"), F.col("n").alias("votes"), "total", (F.col("n") / F.col("total")).alias("share"), F.round(F.col("n") / F.col("total"), 6).alias("purity"))


def ranks(df: DataFrame, keys: list[str], value: str, parts: int = 64) -> DataFrame:
    """``keys, value, _c, _cum, n``: the distinct values of each group with their number, the number of values up to
    them, and the group's size.  Nulls are left out.

    Values are counted first; running sums are taken within ranges of values (approximate quantiles; any bounds give
    the same result) after the sums of the ranges before, so no window holds a whole group.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    shares = ",".join(str(i / parts) for i in range(1, parts))
    bounds = c.agg(F.expr(f"array_distinct(percentile_approx({value}, array({shares}), 1000))").alias("_b"))  # one row
    c = c.crossJoin(F.broadcast(bounds)).withColumn("_p", F.size(F.filter(F.coalesce("_b", F.array()), lambda b: F.col(value) > b))).drop("_b")
    sums = c.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*keys)
    before = F.sum("_s").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"_k{i}" for i in range(len(keys))]
    sums = sums.select(*[F.col(k).alias(x) for k, x in zip(keys, names, strict=True)], F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_s").over(group).alias("n"))
    same = F.col("_p") == F.col("_q")
    for k, x in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(x))
    cum = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy(value)) + F.col("_before")
    return c.join(sums, same).withColumn("_cum", cum).select(*keys, value, "_c", "_cum", "n")


def indexed_quantiles(df: DataFrame, label: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per label n and the sorted values at list index floor(share * n)."""
    c = ranks(df, [label], value)
    return c.groupBy(label, "n").agg(*[F.min(F.when(F.col("_cum") > F.floor(F.col("n") * q), F.col(value))).alias(k) for k, q in shares.items()])


def linear_quantiles(df: DataFrame, label: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per label the quantiles with linear interpolation between neighbours in rank."""
    c = ranks(df, [label], value)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_cum") > rank, F.col(value)))

    out = []
    for k, q in shares.items():
        place = (F.col("n") - 1) * q
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * (F.first(place) - F.floor(F.first(place)))).alias(k))
    return c.groupBy(label).agg(*out)


def dominant_ids(df: DataFrame, key: str, ids: Column, length: Column, repeat: int, sole: int) -> DataFrame:
    """``key, case_id, source``: the identifier found most often, the first on a tie, if found ``repeat`` times
    (dominance); else the only one of a text of ``sole`` characters at most (uniqueness); else no row."""
    p = df.select(key, length.alias("_len"), F.posexplode(ids).alias("_pos", "case_id"))
    c = p.groupBy(key, "_len", "case_id").agg(F.count("*").alias("_n"), F.min("_pos").alias("_pos"))
    w = Window.partitionBy(key)
    c = c.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_n"), "_pos"))).withColumn("_k", F.count("*").over(w))
    source = F.when(F.col("_n") >= repeat, "dominance").when((F.col("_k") == 1) & (F.col("_len") <= sole), "uniqueness")
    return c.where("_r = 1").select(key, "case_id", source.alias("source")).where("source is not null")
