"""Scores of a segmentation or labelling against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.event_log import keep
from .scan import running, slotted


def boundary_matches(gold: Column, pred: Column, tolerance: int) -> Column:
    """Size of the largest one-to-one matching of two sorted arrays within ``tolerance``: a two-pointer sweep.

    Each step moves at least one of the two pointers, so an array of n and one of m edges take n + m steps.
    """
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(gold) + F.size(pred)))
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("tp"))

    def step(s: Column, _: Column) -> Column:
        g, p = F.get(gold, s["i"]), F.get(pred, s["j"])
        move = lambda i, j, tp: F.struct((s["i"] + i).alias("i"), (s["j"] + j).alias("j"), (s["tp"] + tp).alias("tp"))
        return F.when(g.isNull() | p.isNull(), s).when(p < g - tolerance, move(0, 1, 0)).when(p > g + tolerance, move(1, 0, 0)).otherwise(move(1, 1, 1))

    return F.aggregate(steps, state, step)["tp"]


def nearest_first_matches(gold: Column, pred: Column, tolerance: int) -> Column:
    """Size of the matching that takes the nearest pairs first (then the lower places): a comparator, not an optimum."""
    near = F.flatten(
        F.transform(
            gold,
            lambda g, i: F.transform(
                F.filter(F.transform(pred, lambda p, j: F.struct(F.abs(p - g).alias("d"), i.alias("i"), j.alias("j"))), lambda x: x["d"] <= tolerance), lambda x: x
            ),
        )
    )
    none = F.array().cast("array<int>")
    state = F.struct(none.alias("g"), none.alias("p"))

    def step(s: Column, x: Column) -> Column:
        free = ~F.array_contains(s["g"], x["i"]) & ~F.array_contains(s["p"], x["j"])
        return F.when(free, F.struct(F.array_append(s["g"], x["i"]).alias("g"), F.array_append(s["p"], x["j"]).alias("p"))).otherwise(s)

    return F.size(F.aggregate(F.array_sort(near), state, step)["g"])


def prf(tp: Column, n_gold: Column, n_pred: Column, digits: int = 6) -> dict[str, Column]:
    """Precision, recall and F1: all 1 if both sides are empty, all 0 if one is."""
    none = (n_gold == 0) & (n_pred == 0)
    precision = F.when(none, 1.0).when(n_pred == 0, 0.0).otherwise(tp / F.nullif(n_pred, F.lit(0)))
    recall = F.when(none, 1.0).when(n_gold == 0, 0.0).otherwise(tp / F.nullif(n_gold, F.lit(0)))
    f1 = F.when(none, 1.0).when(tp == 0, 0.0).otherwise(2 * tp / F.nullif(n_gold + n_pred, F.lit(0)))
    return {k: F.round(v, digits) for k, v in (("precision", precision), ("recall", recall), ("f1", f1))}


def boundary_scores(gold: DataFrame, pred: DataFrame, keys: DataFrame, key: str, tolerances: tuple[int, ...]) -> DataFrame:
    """``matched_boundaries`` of ``gold(key, g)`` and ``pred(key, p)``, which hold arrays."""
    rows = lambda df, c: df.select(key, F.explode(c).alias("bin"))
    return matched_boundaries(rows(gold, "g"), rows(pred, "p"), keys, [key], tolerances)


def matched_boundaries(gold: DataFrame, pred: DataFrame, keys: DataFrame, by: list[str], tolerances: tuple[int, ...], width: int = 4096, large: DataFrame | None | str = "count") -> DataFrame:
    """``by, tol, tp, n_gold, n_pred`` for every key of ``keys`` and every tolerance, from rows (by, bin); repeated bins count once.

    Boundaries farther apart than the tolerance can't be matched, so the merged ones are cut there, and each chain is
    matched on its own: what is gathered is as long as boundaries follow each other that closely, not as a session.
    """
    side = lambda df, g: df.select(*by, F.col("bin").cast("bigint").alias("bin"), F.lit(g).alias("g"), F.lit(not g).alias("p"))
    both = side(gold, True).unionByName(side(pred, False)).groupBy(*by, "bin").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    both = both if large is None else keep(both, "boundaries")
    d = running(slotted(both, by, "bin", width, large), ["bin"], before={"_prev": F.col("bin")})
    d = running(d, ["bin"], total={f"_c{t}": F.when(F.col("bin") - F.col("_prev") <= t, 0).otherwise(1) for t in tolerances})
    chains = F.explode(F.array(*[F.struct(F.lit(t).alias("tol"), F.col(f"_c{t}").alias("chain")) for t in tolerances])).alias("x")
    chains = d.select(*by, "bin", "g", "p", chains).groupBy(*by, "x.tol", "x.chain").agg(F.sort_array(F.collect_list(F.struct("bin", "g", "p"))).alias("e"), F.max("g").alias("g"), F.max("p").alias("p"))
    bins = lambda c: F.transform(F.filter("e", lambda x: x[c]), lambda x: x["bin"])
    tp = F.coalesce(*[F.when(F.col("tol") == t, boundary_matches(bins("g"), bins("p"), t)) for t in tolerances])
    tp = chains.where("g and p").groupBy(*by, "tol").agg(F.sum(tp).alias("tp"))
    sizes = both.groupBy(*by).agg(F.count_if("g").alias("n_gold"), F.count_if("p").alias("n_pred"))
    every = keys.select(*by).distinct().withColumn("tol", F.explode(F.array(*map(F.lit, tolerances))))
    out = every.join(sizes, by, "left").join(tp, [*by, "tol"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(*by, "tol", zero("tp"), zero("n_gold"), zero("n_pred"))


def drawn_bins(sizes: DataFrame, key: str, seeds: int, large: DataFrame | None | str = "count") -> DataFrame:
    """``key, seed, bin``: of each row of ``sizes(key, n, np)`` and seed ``np`` distinct bins inside (0, n).

    Numbers drawn by a hash with replacement, from as many fewer as there are draws, become distinct ones of the whole
    range when each is moved by its rank among them.
    """
    d = sizes.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds)))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("np").cast("int"))))
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("seed").cast("string"), F.col(key).cast("string"), F.col("i").cast("string")).cast("binary")), 1, 7), 16, 10).cast("bigint")
    d = d.select(key, "seed", "i", (number % (F.col("n") - F.col("np"))).alias("u"))
    d = running(slotted(d, [key, "seed"], "u", 4096, large), ["u", "i"], total={"_r": F.lit(1)})
    return d.select(key, "seed", (F.col("u") + F.col("_r")).alias("bin"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n`` with row, column and total sums."""
    t = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return (
        t.withColumn("na", F.sum("n").over(Window.partitionBy(a)))
        .withColumn("nb", F.sum("n").over(Window.partitionBy(b)))
        .crossJoin(t.agg(F.sum("n").alias("total")))  # one row
    )


def agreement(table: DataFrame, a: str, b: str) -> DataFrame:
    """Homogeneity, completeness, V-measure and adjusted Rand index of a contingency table."""
    n, total = F.col("n"), F.col("total")
    pairs = lambda x: x.cast("double") * (x - 1) / 2
    cond = table.agg(
        -F.sum(n / total * F.log(n / F.col("nb"))),
        -F.sum(n / total * F.log(n / F.col("na"))),
        F.sum(pairs(n)),
        F.max(total),
    ).toDF("h_ab", "h_ba", "s", "total")
    rows = table.select(a, "na", "total").distinct().agg(-F.sum(F.col("na") / F.col("total") * F.log(F.col("na") / F.col("total"))), F.sum(pairs(F.col("na")))).toDF("h_a", "sa")
    cols = table.select(b, "nb", "total").distinct().agg(-F.sum(F.col("nb") / F.col("total") * F.log(F.col("nb") / F.col("total"))), F.sum(pairs(F.col("nb")))).toDF("h_b", "sb")
    x = cond.crossJoin(rows).crossJoin(cols)  # one row each
    h = F.when(F.col("h_a") == 0, 1.0).otherwise(1 - F.col("h_ab") / F.col("h_a"))
    c = F.when(F.col("h_b") == 0, 1.0).otherwise(1 - F.col("h_ba") / F.col("h_b"))
    x = x.withColumn("homogeneity", h).withColumn("completeness", c)
    both = F.col("homogeneity") + F.col("completeness")
    chance = F.col("sa") * F.col("sb") / pairs(F.col("total"))
    spread = (F.col("sa") + F.col("sb")) / 2 - chance
    return x.select(
        F.round("homogeneity", 6).alias("homogeneity"),
        F.round("completeness", 6).alias("completeness"),
        F.round(F.when(both == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / both), 6).alias("v_measure"),
        F.round(F.when(spread == 0, 1.0).otherwise((F.col("s") - chance) / spread), 6).alias("adjusted_rand"),
    )


def grouped_agreement(df: DataFrame, by: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """``by, n, clusters, v_measure, adjusted_rand`` of the labels ``a`` against ``b`` in each group, of rows or of counts.

    Counts of pairs come first; a group's sums then run over its distinct pairs, not over its rows.
    """
    c = df.groupBy(*by, a, b).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    wa, wb, every = Window.partitionBy(*by, a), Window.partitionBy(*by, b), Window.partitionBy(*by)
    c = c.withColumns({"na": F.sum("n").over(wa), "nb": F.sum("n").over(wb), "t": F.sum("n").over(every)})
    n, t = F.col("n"), F.col("t")
    two = lambda x: x.cast("double") * (x - 1) / 2
    # a row of a label carries its part n / na of the label's own term
    s = c.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count_distinct(b).alias("clusters"),
        (-F.sum(n / t * F.log(n / F.col("nb")))).alias("hab"), (-F.sum(n / t * F.log(n / F.col("na")))).alias("hba"),
        (-F.sum(n / t * F.log(F.col("na") / t))).alias("ha"), (-F.sum(n / t * F.log(F.col("nb") / t))).alias("hb"),
        F.sum(two(n)).alias("s"), F.sum(n * (F.col("na") - 1) / 2).alias("sa"), F.sum(n * (F.col("nb") - 1) / 2).alias("sb"),
    )
    h = F.when(F.col("ha") < 1e-15, 1.0).otherwise(1 - F.col("hab") / F.col("ha"))
    k = F.when(F.col("hb") < 1e-15, 1.0).otherwise(1 - F.col("hba") / F.col("hb"))
    s = s.withColumns({"h": h, "k": k, "chance": F.col("sa") * F.col("sb") / F.greatest(two(F.col("n")), F.lit(1.0))})
    spread = (F.col("sa") + F.col("sb")) / 2 - F.col("chance")
    v = F.when(F.col("h") + F.col("k") < 1e-12, 0.0).otherwise(2 * F.col("h") * F.col("k") / (F.col("h") + F.col("k")))
    return s.select(*by, "n", "clusters", F.round(v, 6).alias("v_measure"), F.round(F.when(F.abs(spread) < 1e-12, 1.0).otherwise((F.col("s") - F.col("chance")) / spread), 6).alias("adjusted_rand"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], digest: Column, name: str) -> DataFrame:
    """Adds ``name``: the place of each row (from 1) in the order of a hex ``digest``, then ``order``, within ``keys``.

    Rows are dealt by the first two digits of the digest and counted, so that no window holds a whole group.
    """
    d = df.withColumn("_d", digest).withColumn("_part", F.substring("_d", 1, 2))
    n = d.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_d", *order)) + F.col("_before")
    return d.join(n, [*keys, "_part"]).withColumn(name, place).drop("_d", "_part", "_before")


def shuffled(df: DataFrame, ident: str, label: str, draws: int) -> DataFrame:
    """``draw, ident, label``: the labels dealt anew to the rows, once per draw, by ranks of two digests."""
    rows = df.select(F.col(ident), F.col(label)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    text = lambda mark: F.md5(F.concat_ws("-", F.col("draw").cast("string"), F.lit(mark), F.col(ident).cast("string")).cast("binary"))
    here = ranked(rows, ["draw"], [F.col(ident)], text("a"), "_r").select("draw", ident, "_r")
    there = ranked(rows, ["draw"], [F.col(ident)], text("b"), "_r").select("draw", label, "_r")
    return here.join(there, ["draw", "_r"]).drop("_r")


def ks_statistic(df: DataFrame, value: str, side: Column, parts: int = 64) -> DataFrame:
    """Kolmogorov-Smirnov distance of the values where ``side`` holds and where it does not.

    Values are counted first.  The running sums are taken within ranges of values, whose bounds are approximate
    quantiles (any bounds give the same result), after the sums of the ranges before.
    """
    t = df.groupBy(value).agg(F.count_if(side).alias("x"), F.count_if(~side).alias("y"))
    shares = ",".join(str(i / parts) for i in range(1, parts))
    bounds = t.agg(F.expr(f"array_distinct(percentile_approx({value}, array({shares}), 1000))").alias("_b"))  # one row
    part = F.size(F.filter(F.coalesce("_b", F.array()), lambda b: F.col(value) > b))
    t = t.crossJoin(F.broadcast(bounds)).withColumn("_p", part).drop("_b")
    sums = t.groupBy("_p").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    zero = F.lit(0).cast("bigint")
    sums = sums.select("_p", F.coalesce(F.sum("sx").over(before), zero).alias("bx"), F.coalesce(F.sum("sy").over(before), zero).alias("by"))
    w = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(F.broadcast(sums), "_p").select((F.sum("x").over(w) + F.col("bx")).alias("x"), (F.sum("y").over(w) + F.col("by")).alias("y"))
    top = t.agg(F.max("x").alias("nx"), F.max("y").alias("ny"))
    return t.crossJoin(F.broadcast(top)).agg(F.round(F.max(F.abs(F.col("x") / F.col("nx") - F.col("y") / F.col("ny"))), 6).alias("ks"))
