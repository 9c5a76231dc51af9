"""Segmented scans, chains, suppression in rounds and vocabularies: cut keys give what whole ones give."""

import random

import pytest
from pyspark.sql import functions as F

from tracework import catalogue as K
from tracework.functions import regulations as J
from tracework.operators import brackets as B
from tracework.operators import grid as G
from tracework.operators import labels as L
from tracework.operators import scan
from tracework.operators import scoring as S
from tracework.operators import sequence as Q
from tracework.operators import suppress as X
from tracework.sources.event_log import activity
from tracework.streaming import confirmations as C

SF = "/root/testdata/sf0.001"


def log(spark, seed=1, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(0, 400)]), i, rng.choice([None, None, 1, 2, 3])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t bigint, i int, v int")


def both_ways(spark, monkeypatch, f):
    """Rows of ``f`` with whole keys and with all keys cut."""
    whole = sorted(map(repr, f().collect()))
    monkeypatch.setattr(scan, "MOST", 0)
    monkeypatch.setattr(scan, "large_keys", lambda df, keys, most=0: df.select(*keys).distinct())
    return whole, sorted(map(repr, f().collect()))


def test_running_values_do_not_depend_on_ranges(spark, monkeypatch):
    d = log(spark)
    v = F.col("v")
    f = lambda: scan.running(scan.slotted(d, ["k"], "t", 17), ["t", "i"], last={"a": v}, before={"b": v}, after={"c": v}, beyond={"d": v}, earlier={"e": F.when(v == 1, F.col("t"))}, total={"f": v}).drop(scan.SLOT)
    whole, cut = both_ways(spark, monkeypatch, f)
    assert whole == cut and len(whole) == 300


@pytest.mark.parametrize("name", ["gaps", "runs", "fill", "neighbours", "asof", "filled", "state_at", "expand"])
def test_operators_do_not_depend_on_ranges(spark, monkeypatch, name):
    d = log(spark, 2).where("t is not null")
    u = d.where("i % 9 = 0").select("k", F.col("t").alias("start_ts"), (F.col("t") + F.col("i") % 30).alias("end_ts"), "i").where("k is not null")
    f = {
        "gaps": lambda: Q.gap_sessions(d, ["k"], "t", 3, ["i"], width=17),
        "runs": lambda: Q.change_runs(d, ["k"], ["t", "i"], "v", width=17),
        "fill": lambda: Q.fill(d, ["k"], ["t", "i"], "v", "x", width=17),
        "neighbours": lambda: Q.neighbours(d, ["k"], "t", F.col("v") == 2, ["i"], width=17),
        "asof": lambda: G.asof(u, "k", "end_ts", d.where("v = 1").distinct(), "t", "i", 17),
        "filled": lambda: L.filled(d.withColumn("v", F.col("v").cast("string")), ["k"], [F.col("t"), F.col("i")], ["v"], 17),
        "state_at": lambda: L.state_at(u, d.select("k", "t", "i", "v"), "k", "end_ts", ["t", "i"], "v", 17),
        "expand": lambda: B.expand(u.groupBy("k", "start_ts").agg(F.max("end_ts").alias("end_ts")), B.bounds(d, "k", "t"), "k", 50, 17),
    }[name]
    whole, cut = both_ways(spark, monkeypatch, f)
    assert whole == cut and whole


def test_brackets_see_far_enough_back(spark):
    rng = random.Random(3)
    rows = sorted({(1, rng.randrange(3000)): rng.choice("oxc") for _ in range(900)}.items())
    d = spark.createDataFrame([(k, t, e) for (k, t), e in rows], "k int, t bigint, e string")
    got = sorted(map(tuple, B.bracket_pairs(d.withColumn("t", F.col("t") * 10**9), "k", "t", F.col("e") == "o", F.col("e") == "c", 20 * 10**9, 2 * 10**9).collect()))
    want, prev = [], None
    times = [(t, e) for (_, t), e in rows]
    for t, e in times:
        if e == "c":
            reach = max(t - 20, prev if prev is not None else -1)
            opens = [x for x, y in times if y == "o" and x < t]
            has = bool(opens) and opens[-1] >= reach
            start = opens[-1] if has else max(prev if prev is not None else -1, min(x for x, _ in times if t - 20 <= x <= t))
            if t - start >= 2:
                want.append((1, start * 10**9, t * 10**9, has))
            prev = t
    assert got == sorted(want)


def test_one_session_of_all_rows_is_many_tasks(spark):
    a = activity(spark, "/root/testdata/sf0.1").where("event_id % 4 = 0").withColumn("session_id", F.lit(1)).withColumn("v", F.when(F.col("event_type") == "view", F.col("k")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        q = Q.fill(a, ["session_id"], ["t", "event_id"], "v", "state")
        sizes = [r.n for r in q.select("state", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.max("state")).collect()]
        assert len(sizes) > 2 and sum(sizes) == a.count() and max(sizes) < sum(sizes) / 2
        units = B.bracket_pairs(a, "session_id", "t", F.col("event_type") == "view", F.col("event_type") == "purchase", K.MAX_UNIT, K.MIN_UNIT)
        assert units.select("start_ts", F.spark_partition_id().alias("p")).groupBy("p").agg(F.max("start_ts")).count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("cut", [False, True])
def test_chains_match_as_whole_sessions_do(spark, cut):
    rng = random.Random(4)
    rows = [(k, rng.randrange(2000), rng.random() < 0.5) for k in range(3) for _ in range(700)] + [(7, 5, True)]
    d = spark.createDataFrame(rows, "k int, bin bigint, g boolean")
    gold, pred, keys = d.where("g").select("k", "bin"), d.where("not g").select("k", "bin"), d.select("k")
    large = keys.distinct() if cut else None
    got = {(r.k, r.tol): (r.tp, r.n_gold, r.n_pred) for r in S.matched_boundaries(gold, pred, keys, ["k"], (0, 2, 5), 64, large).collect()}
    for k in (0, 1, 2, 7):
        g, p = sorted({b for q, b, x in rows if q == k and x}), sorted({b for q, b, x in rows if q == k and not x})
        for tol in (0, 2, 5):
            i = j = tp = 0
            while i < len(g) and j < len(p):
                if abs(g[i] - p[j]) <= tol:
                    i, j, tp = i + 1, j + 1, tp + 1
                elif g[i] < p[j]:
                    i += 1
                else:
                    j += 1
            assert got[k, tol] == (tp, len(g), len(p))


def test_suppression_in_rounds_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(1, t, float(-t)) for t in range(0, 600, 3)] + [(2, rng.randrange(5000), float(rng.randrange(50))) for _ in range(900)]
    best = {}
    for k, t, v in rows:
        best[k, t] = max(v, best.get((k, t), v))
    want = set()
    for k in (1, 2):
        kept = []
        for t in sorted((t for q, t in best if q == k), key=lambda t: (-best[k, t], t)):
            if all(abs(t - x) >= 7 for x in kept):
                kept.append(t)
        want |= {(k, t) for t in kept}
    d = spark.createDataFrame(rows, "k int, t bigint, v double")
    for reach in (4, 1024):  # a falling ramp over many ranges, and one range
        got = X.non_max(d, "k", "t", "v", 7, reach).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_ten_thousand_fragments(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    fragments = sorted({word() for _ in range(9000)} | {f"system {i}" for i in range(3000)})
    texts = [" ".join(word() for _ in range(4)) for _ in range(150)] + ["the system 2999 is", "", "x", None]
    got = L.first_matches(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(f,) for f in [*fragments, None]], "fragment string"))
    want = {(t, min((f for f in fragments if f in t), key=str.encode)) for t in texts if t is not None and any(f in t for f in fragments)}
    assert {(r.text, r.fragment) for r in got.collect()} == want
    plan = L.first_matches(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([("",)], "fragment string"))
    assert [tuple(r) for r in plan.collect()] == [("a", "")]


def test_a_cell_is_no_template(spark):
    row = F.create_map(F.lit("ID"), F.lit("{kind}"), F.lit("kind"), F.lit("x"), F.lit("a"), F.lit(None).cast("string"))
    t = lambda s: spark.createDataFrame([(s,)], "t string").select(J.filled_template(F.col("t"), row, F.lit("?"))).first()[0]
    assert t("{ID} needs {kind}") == "{kind} needs x"
    assert [t(s) for s in ("{a}{a}", "x {", "{ {kind}", "{no}", "{}", "", "} {kind}} y")] == ["", "x {", "{ x", "?", "?", "", "} x} y"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = [(i % 7, i, i, f"n{i}") for i in range(40)]
    spark.createDataFrame(rows, "row_id bigint, t bigint, event_id bigint, note string").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id bigint, t bigint, event_id bigint, note string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    assert C.confirmations(stream, out, str(tmp_path / "c")).awaitTermination(120)
    read = lambda: sorted(map(tuple, spark.read.parquet(out).collect()))
    before = read()
    assert len(before) == 40 and {r.row_id: r.note for r in C.confirmed(spark, out).collect()} == {i % 7: f"n{i}" for i in range(33, 40)}
    again = spark.createDataFrame([r for r in before if r[4] == 1], "row_id bigint, t bigint, event_id bigint, note string, batch bigint").drop("batch")
    C.write_batch(again, 1, out)
    assert read() == before


@pytest.mark.parametrize("cut", [False, True])
def test_chance_draws_as_many_distinct_boundaries(spark, cut):
    sizes = spark.createDataFrame([("a", 50, 49), ("b", 1000, 3), ("c", 9, 1), ("d", 5000, 2500)], "k string, n bigint, np bigint")
    d = S.drawn_bins(sizes, "k", 3, sizes.select("k") if cut else None)
    got = d.groupBy("k", "seed").agg(F.count_distinct("bin").alias("m"), F.count("*").alias("n"), F.min("bin").alias("lo"), F.max("bin").alias("hi")).collect()
    want = {r.k: (r.n, r.np) for r in sizes.collect()}
    assert len(got) == 12 and all(r.m == r.n == want[r.k][1] and 0 < r.lo and r.hi < want[r.k][0] for r in got)
