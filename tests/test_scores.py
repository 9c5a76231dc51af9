"""Scores and audits against brute force and known identities."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tracework import catalogue as K
from tracework import desk
from tracework.functions import regulations as J
from tracework.operators import audits as U
from tracework.operators import intervals as I
from tracework.operators import labels as L
from tracework.operators import scoring as S
from tracework.sources import event_log as E

SF = "/root/testdata/sf0.001"


def best_matching(gold, pred, tolerance):
    """The largest one-to-one matching, by augmenting paths."""
    owner = {}

    def augment(i, seen):
        for j, p in enumerate(pred):
            if abs(p - gold[i]) <= tolerance and j not in seen:
                seen.add(j)
                if j not in owner or augment(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(augment(i, set()) for i in range(len(gold)))


def test_two_pointer_matching_is_the_largest(spark):
    rng = random.Random(1)
    rows = [(i, sorted(rng.sample(range(40), rng.randrange(9))), sorted(rng.sample(range(40), rng.randrange(9)))) for i in range(300)]
    rows += [(1000, [10, 11], [11, 13]), (1001, [10, 12], [8, 11]), (1002, [], []), (1003, [5], [])]
    df = spark.createDataFrame(rows, "i int, g array<bigint>, p array<bigint>")
    got = df.select("i", S.boundary_matches(F.col("g"), F.col("p"), 2).alias("best"), S.nearest_first_matches(F.col("g"), F.col("p"), 2).alias("near")).collect()
    for (_, g, p), r in zip(rows, sorted(got, key=lambda r: r.i), strict=True):
        assert r.best == best_matching(g, p, 2) >= r.near


def test_scores_of_equal_empty_and_one_sided_boundaries(spark):
    keys = spark.createDataFrame([(k,) for k in range(4)], "k int")
    gold = spark.createDataFrame([(0, [3, 9]), (1, [4])], "k int, g array<bigint>")
    pred = spark.createDataFrame([(0, [3, 9]), (2, [4])], "k int, p array<bigint>")
    rows = S.boundary_scores(gold, pred, keys, "k", (2,)).withColumns(S.prf(F.col("tp"), F.col("n_gold"), F.col("n_pred"))).collect()
    assert {r.k: (r.precision, r.recall, r.f1) for r in rows} == {0: (1, 1, 1), 1: (0, 0, 0), 2: (0, 0, 0), 3: (1, 1, 1)}


def test_permutations_equal_the_exact_tail(spark):
    rows = [("a", 1)] * 14 + [("a", 0)] * 6 + [("b", 1)] * 20 + [("b", 0)] * 30 + [("c", None), (None, 1)]
    got = {r.g: r for r in U.permutation_tests(spark.createDataFrame(rows, "g string, v int"), "g", "v", draws=20_000).collect()}
    n, ones, size = 20, 34, 70
    mean = lambda k: k / n - (ones - k) / (size - n)
    tail = sum(math.comb(ones, k) * math.comb(size - ones, n - k) for k in range(n + 1) if abs(mean(k)) >= abs(mean(14)) - 1e-12) / math.comb(size, n)
    assert abs(got["a"].p - tail) < 0.01 and got["a"].p == pytest.approx(got["b"].p, abs=0.01)
    assert got["a"].p_corrected == pytest.approx(min(1, 2 * got["a"].p), abs=2e-6)


def test_shuffles_are_permutations(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(500)], "i bigint, label string")
    dealt = S.shuffled(df, "i", "label", 3)
    assert {tuple(r) for r in dealt.groupBy("draw", "label").count().collect()} == {(d, x, n) for d in (1, 2, 3) for x, n in (("x", 167), ("y", 167), ("z", 166))}
    assert dealt.select("draw", "i").distinct().count() == 1500
    moved = dealt.join(df.withColumnRenamed("label", "own"), "i").where("label <> own").count()
    assert moved > 800


@pytest.mark.parametrize("parts", [2, 7, 64])
def test_ks_does_not_depend_on_ranges(spark, parts):
    rng = random.Random(2)
    a, b = [rng.gauss(0, 1) for _ in range(400)], [rng.gauss(0.4, 1) for _ in range(300)]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "v double, side boolean")
    want = max(abs(sum(x <= v for x in a) / 400 - sum(x <= v for x in b) / 300) for v in a + b)
    assert S.ks_statistic(df, "v", F.col("side"), parts).first().ks == pytest.approx(want, abs=1e-6)


def test_grouped_agreement_of_equal_and_of_independent_labels(spark):
    rows = [("same", x % 3, x % 3) for x in range(30)] + [("apart", x % 2, x // 2 % 2) for x in range(40)] + [("one", 0, 0)] * 5
    got = {r.by: (r.v_measure, r.adjusted_rand) for r in S.grouped_agreement(spark.createDataFrame(rows, "by string, a int, b int"), ["by"], "a", "b").collect()}
    assert got["same"] == (1, 1) and got["one"] == (1, 1) and got["apart"][0] == 0 and got["apart"][1] < 0.01


def test_interval_joins_equal_loops(spark):
    rng = random.Random(3)
    units = [(k, a, a + rng.randrange(1, 60)) for k in range(3) for a in rng.sample(range(200), 15)]
    others = [(k, a, a + rng.randrange(0, 60)) for k in range(3) for a in rng.sample(range(200), 15)]
    points = [(k, t) for k in range(3) for t in rng.sample(range(300), 40)]
    u, o, p = (spark.createDataFrame(x, s) for x, s in ((units, "k int, start_ts bigint, end_ts bigint"), (others, "k int, start_ts bigint, end_ts bigint"), (points, "k int, t bigint")))
    for width in (7, 1000):
        got = I.containment(u, p, "k", "t", width, "inner").select("k", "start_ts", "end_ts", "t").collect()
        assert sorted(map(tuple, got)) == sorted((k, a, b, t) for k, a, b in units for q, t in points if k == q and a <= t <= b)
        pairs = I.overlaps(u, o, "k", width).select("k", "gs", "ge", "ps", "pe").collect()
        assert sorted(map(tuple, pairs)) == sorted((k, a, b, c, d) for k, a, b in units for q, c, d in others if k == q and c < b and d > a)


def test_a_session_against_itself_is_perfect(spark):
    bounds = K.B.bounds(K.activity(spark, SF), "session_id", "t")
    edges = K._edges(K._units(spark, SF), bounds)
    gold, pred = edges.withColumnRenamed("bins", "g"), edges.withColumnRenamed("bins", "p")
    rows = S.boundary_scores(gold, pred, bounds, "session_id", (2, 5, 10)).withColumns(S.prf(F.col("tp"), F.col("n_gold"), F.col("n_pred"))).collect()
    assert rows and all(r.f1 == 1 for r in rows)


def test_missing_data_is_named_and_blank_lines_are_skipped(spark, tmp_path):
    folder = tmp_path / "ds=a" / "chunk=c1"
    folder.mkdir(parents=True)
    (folder / "events.jsonl").write_text('{"event_id":"1","session_id":"s","timestamp_ms":5,"event_type":"shortcut","payload":{"keys":["a","b"],"modifiers":{"ctrl":true,"alt":false}}}\n\n   \n{"event_id":"2","session_id":"s","timestamp_ms":5,"event_type":"other"}\n{"event_id":"3","session_id":"s","timestamp_ms":5,"event_type":"browser_form_input","payload":{"url":"","field":{"label":"","placeholder":"p","input_type":"text"}},"context":{"active_browser_tab":{"url":"u"},"extracted_text":{"text":""}}}\n')
    rows = {r.event_id: r for r in E.read_log(spark, str(tmp_path)).collect()}
    assert len(rows) == 3 and len(rows["1"]) == 35
    assert (rows["1"].key, rows["1"].mods, rows["1"].ds) == ("a+b", "ctrl", "a") and rows["2"].key is None
    assert (rows["3"].url, rows["3"].el_name, rows["3"].el_type, rows["3"].has_text) == ("u", "p", "text", False)
    with pytest.raises(FileNotFoundError, match="events"):
        E.require_rows(spark.createDataFrame([], "a int"), "events")
    assert len(desk.FLAT) == 35


def test_titles_slugs_rows_and_templates(spark):
    one = lambda schema, row, *c: spark.createDataFrame([row], schema).select(*c).first()
    assert one("t string", ("財務 and 3 more pages - Profile 1 - Edge",), L.title_head(F.col("t")))[0] == "財務"
    assert one("t string", ("規程集　 [Compatibility Mode] - Word",), L.document_title(F.col("t")))[0] == "規程集"
    assert one("t string", ("memo",), L.document_title(F.col("t")))[0] is None
    assert one("t string", ("abc",), L.slug(F.col("t")))[0] == "sys_a999"
    assert one("t string", ("　b c",), L.route_of_text(F.col("t"), [("b", "x"), ("b c", "y")]))[0] == "y"
    text = "申請規程 第1条 甲。附則 終。\r旅費規程 第1条 乙\r申請規程 第1条 丙"
    assert one("t string", (text,), J.bodies(F.col("t")))[0] == {"旅費規程": "旅費規程 第1条 乙\r", "申請規程": "申請規程 第1条 丙"}
    assert one("t string", (None,), J.bodies(F.col("t")))[0] == {}
    row = F.create_map(F.lit("ID"), F.lit("7"), F.lit("x"), F.lit(None).cast("string"))
    for template, want in (("{ID}: {x}.", "7: ."), ("{ID} {y}", "none"), ("plain", "plain")):
        assert one("t string", (template,), J.filled_template(F.col("t"), row, F.lit("none")))[0] == want


def test_filled_states_and_state_at(spark):
    rows = [("s", 1, None, ""), ("s", 2, "a", None), ("s", 3, None, None), ("s", 4, "b", "z")]
    got = L.filled(spark.createDataFrame(rows, "k string, t int, x string, y string"), ["k"], [F.col("t")], ["x", "y"]).orderBy("t").collect()
    assert [r.x for r in got] == ["a", "a", "a", "b"] and [r.y for r in got] == ["z"] * 4
    units = spark.createDataFrame([("s", 0), ("s", 3), ("q", 5)], "k string, e int")
    states = spark.createDataFrame([("s", 1, "a"), ("s", 3, "b")], "k string, t int, v string")
    assert {(r.k, r.e): r.v for r in L.state_at(units, states, "k", "e", ["t"], "v").collect()} == {("s", 0): "a", ("s", 3): "b", ("q", 5): None}


def test_anchors_keep_the_text_before_the_click(spark):
    a = spark.createDataFrame([("s", 1, "c", "click", "x"), ("s", 1, "c", "dominance", None), ("s", 2, "c", "click", None)], "session_id string, ts_ms int, case string, source string, hint string")
    assert sorted((r.ts_ms, r.source) for r in L.first_by_source(a).collect()) == [(1, "dominance"), (2, "click")]
    log = spark.createDataFrame([("s", 1, "給与計算　INV-2024-7 "), ("s", 2, "A-11-1, B-22-2 A-11-1"), ("s", 3, None)], "session_id string, ts_ms int, el_name string")
    got = sorted((r.ts_ms, r.case, r.hint) for r in L.click_anchors(log).collect())
    assert got == [(1, "INV-2024-7", "給与計算"), (2, "A-11-1", None), (2, "B-22-2", None)]


def test_every_query_of_the_catalogue_has_rows(spark):
    assert len(K.queries()) >= 140 and set(K.queries()) - set(K.oracle_sql()) <= {"non_max_suppression", "unit_clusters", "unit_linkage", "learned_brackets", "permutation_test", "event_tags"}
    assert list(itertools.islice(K.oracle_sql(), 1))
