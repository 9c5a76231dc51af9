"""What has no SQL: regulation text, screen tables, suppression, streams; and the grid's edge cases."""

import random

from pyspark.sql import functions as F

from tracework import catalogue
from tracework.functions import regulations as J
from tracework.operators import grid as G
from tracework.operators import learn as L
from tracework.operators import suppress as X
from tracework.streaming import counts as C

TEXT = "接待交際費規程\r第1条 接待交際費の承認\n5万円未満：部門長承認\n5万円以上：役員承認。金額が200,000円を超える場合は取締役会の決議が必要。家族手当は3,000円以上場合は支給。附則 施行。\r承認記録 残業手当調整"


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_threshold_rules_and_routes(spark):
    r = one(spark, "t string", (TEXT,), J.threshold_rules(F.col("t")))[0]
    assert [tuple(x) for x in r] == [(50000, "未満", "部門長承認"), (50000, "以上", "役員承認"), (200000, "超", "取締役会決議")]
    for amount, want in ((49_999, "部門長承認"), (50_000, "役員承認"), (200_000, "役員承認"), (200_001, "取締役会決議")):
        assert one(spark, "t string, a bigint", (TEXT, amount), J.route_by(F.col("a"), J.threshold_rules(F.col("t"))))[0] == want
    assert one(spark, "t string", ("",), J.threshold_rules(F.col("t")))[0] == []
    assert one(spark, "t string", (None,), J.threshold_rules(F.col("t")))[0] is None


def test_governs_and_sanitised(spark):
    g = lambda s: one(spark, "t string, s string", (TEXT, s), J.governs(F.col("t"), F.col("s")))[0]
    assert g("接待交際費") and not g("残業手当調整") and not g(" ") and not g(None)
    clean = one(spark, "t string", ("甲規程\r承認記録 x\r第1条\r附則 終。\r外",), J.sanitised(F.col("t"), ["承認記録"]))[0]
    assert clean == "甲規程\r第1条\r附則 終。"


def test_screen_rows(spark):
    text = "x\n申請一覧\nID\n氏名\n状態\nP1-2-3\nA\n待\n余分\nP1-2-4\nB\n済\nP9-9-9\n"
    rows = one(spark, "t string", (text,), J.screen_rows(F.col("t")))[0]
    assert rows == [{"ID": "P1-2-3", "氏名": "A", "状態": "待"}, {"ID": "P1-2-4", "氏名": "B", "状態": "済"}]
    assert one(spark, "t string", ("なし",), J.screen_rows(F.col("t")))[0] == []


def test_suppression_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(s, rng.randrange(400), float(rng.randrange(6))) for s in range(4) for _ in range(40)] + [(0, None, 1.0), (1, 5, None)]
    want = set()
    for s in range(4):
        best: dict[int, float] = {}
        for k, t, v in rows:
            if k == s and t is not None and v is not None:
                best[t] = max(v, best.get(t, v))
        kept: list[int] = []
        for t in sorted(best, key=lambda t: (-best[t], t)):
            if all(abs(t - x) >= 7 for x in kept):
                kept.append(t)
        want |= {(s, t) for t in kept}
    got = X.non_max(spark.createDataFrame(rows, "s int, t bigint, v double"), "s", "t", "v", 7).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_asof_keeps_rows_without_targets_and_takes_the_earlier_on_a_tie(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (2, 5)], "k int, g bigint")
    targets = spark.createDataFrame([(1, 8, "a"), (1, 12, "b")], "k int, at bigint, value string")
    rows = G.asof(df, "k", "g", targets, "at", "value").select("k", G.nearer(F.col("g"), 2)["value"].alias("v")).collect()
    assert sorted((r.k, r.v or "") for r in rows) == [(1, "a"), (1, "a"), (2, "")]


def test_window_diff_of_equal_and_of_empty_boundaries(spark):
    b = spark.createDataFrame([(1, 0, 20), (2, 0, 1)], "key int, t0 bigint, t1 bigint")
    e = spark.createDataFrame([(1, 5), (1, 9)], "key int, bin bigint")
    assert {r.key: r.window_diff for r in G.window_diff(e, e, b, "key", 1).collect()} == {1: 0.0, 2: 0.0}


def test_stream_counts_equal_the_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = src.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, f in (("counts", lambda d: C.window_counts(d, "1 day", late="60 days")), ("sessions", lambda d: C.sessions(d, "6 hours", late="60 days"))):
        s = f(C.event_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append")
        q = s.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got, want = {tuple(r) for r in spark.table(name).collect()}, {tuple(r) for r in f(batch).collect()}
        assert got <= want and (name == "sessions" or got == want)  # sessions that the watermark closes: tests/test_streams.py


def test_drafted_rules(spark):
    reply = '```json\n[{"yen": 200000, "cmp": "超", "outcome": "取締役会決議"}, {"yen": 50000, "cmp": "未満", "outcome": "部門長承認"}, {"yen": 50000, "cmp": "以上", "outcome": "役員承認"}]\n```'
    same = J.same_rules(J.drafted_rules(F.col("r")), J.threshold_rules(F.col("t")))
    assert one(spark, "r string, t string", (reply, TEXT), same)[0] is True
    assert one(spark, "r string, t string", ("[]", TEXT), same)[0] is False
    assert one(spark, "r string, t string", ("none", TEXT), same)[0] is None
    row = one(spark, "t string", (TEXT,), J.ungoverned(F.lit("automated_by_rule"), F.col("t"), F.lit("残業手当調整")), J.ungoverned(F.lit("done"), F.col("t"), F.lit("x")))
    assert tuple(row) == (True, False)


def test_clusters_and_tagger(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["x", "y"]) for i in range(20)]
    got = {r.i: r.cluster for r in L.token_clusters(spark.createDataFrame(rows, "i int, w array<string>"), "w", 2).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == 1 and got[0] != got[1]
    assert L.token_clusters(spark.createDataFrame([(1, None)], "i int, w array<string>"), "w", 2).first().cluster == 0
    d = spark.createDataFrame([(float(i), 1.0, "low" if i < 20 else "mid" if i < 40 else "high") for i in range(60)], "x double, y double, c string")
    out = L.tagger(d, "c", ["x", "y"]).transform(d)
    assert out.where("_label = prediction").count() >= 57


def test_boosted_scores_of_held_out_rows(spark):
    rows = [(i, float(i % 30), None if i % 7 == 0 else 1.0, 1 if i % 30 < 8 else 2 if i % 30 >= 22 else 0) for i in range(300)]
    d = spark.createDataFrame(rows, "i int, x double, y double, c int")
    out = L.boosted_scores(d.where("i % 2 = 0"), d.where("i % 2 = 1"), "c", [1, 2, 3], ["x", "y"], rounds=5)
    assert out.columns == ["i", "x", "y", "c", "score_1", "score_2", "score_3"]
    got = out.collect()
    assert all((r.score_1 > 0.5) == (r.c == 1) and (r.score_2 > 0.5) == (r.c == 2) and r.score_3 == 0 for r in got if r.i % 30 not in (7, 8, 21, 22))
    one = d.where("c = 1")
    assert {r.score_1 for r in L.boosted_scores(one, d, "c", [1], ["x"]).collect()} == {1.0}
    assert {r.score_1 for r in L.boosted_scores(d.where("false"), d, "c", [1], ["x"]).collect()} == {0.0}


def test_learned_brackets_beat_gap_sessions(spark):
    got = {(r.arm, r.half, r.tol): r for r in catalogue.queries()["learned_brackets"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 12
    for half in (0, 1):
        assert got["learned", half, 5].f1 > got["gaps", half, 5].f1 and got["learned", half, 5].n_pred > 0
