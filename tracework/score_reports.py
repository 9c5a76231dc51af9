"""Registered queries that score and audit segmentations and labels: chance, permutations, sweeps, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import _BDS, _EDGES, _GROUPS, _PAIRS, _PRF, _SCORED, GAP, HOUR, MAX_UNIT, MIN_UNIT, _A, _edge_rows, _edges, _match_sql, _pred, _scores, _units, _units_sql, large_sessions, query
from .operators import audits as U
from .operators import brackets as B
from .operators import intervals as I
from .operators import scoring as S
from .operators import sequence as Q
from .sources.event_log import activity, keep, table


def _bounds(spark, sf_dir):
    return B.bounds(activity(spark, sf_dir), "session_id", "t")


@query(f"""{_SCORED}, m AS (SELECT session_id % 7 AS machine, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_pred) AS BIGINT) AS n_pred FROM sc WHERE tol = 5 GROUP BY 1),
o AS (SELECT machine, (SELECT CAST(sum(tp) AS BIGINT) FROM m) - tp AS tp, (SELECT CAST(sum(n_gold) AS BIGINT) FROM m) - n_gold AS n_gold, (SELECT CAST(sum(n_pred) AS BIGINT) FROM m) - n_pred AS n_pred FROM m)
SELECT 'only' AS part, m.*, {_PRF} FROM m UNION ALL SELECT 'without' AS part, o.*, {_PRF} FROM o""")
def leave_one_out(spark, sf_dir):
    """Scores of each machine alone, and of all the others: totals less its own."""
    names = ("tp", "n_gold", "n_pred")
    m = _scores(spark, sf_dir, (5,)).groupBy((F.col("session_id") % 7).alias("machine")).agg(*[F.sum(c).alias(c) for c in names])
    total = m.agg(*[F.sum(c).alias(f"all_{c}") for c in names])  # one row
    rest = m.crossJoin(F.broadcast(total)).select("machine", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in names])
    both = m.select(F.lit("only").alias("part"), "*").unionByName(rest.select(F.lit("without").alias("part"), "*"))
    return both.withColumns(S.prf(F.col("tp"), F.col("n_gold"), F.col("n_pred")))


SEEDS = 5
_B0 = _BDS.replace("bd AS", "b0 AS", 1)
_EDGES0 = _EDGES.replace("JOIN bd", "JOIN b0")
#: Sessions of each seed (or setting) are told apart by a last digit.
_CHANCE = f"""{_B0}, ge AS ({_EDGES0.format('units')}), pe AS ({_EDGES0.format('pred')}),
sd AS (SELECT * FROM (SELECT b0.session_id, CAST(ceil((t1 - t0) / {HOUR}) AS BIGINT) AS n, count(*) AS np FROM b0 JOIN pe USING (session_id) GROUP BY ALL), range(1, {SEEDS + 1}) t(seed)),
dr AS (SELECT session_id, seed, i, CAST(concat('0x', substr(md5(concat_ws('-', seed, session_id, i)), 1, 7)) AS BIGINT) % (n - np) AS u FROM sd, range(1, 100000) q(i) WHERE i <= np),
rb AS (SELECT session_id * 10 + seed AS session_id, u + row_number() OVER (PARTITION BY session_id, seed ORDER BY u, i) AS bin FROM dr),
bd AS (SELECT session_id * 10 + seed AS session_id FROM b0, range(1, {SEEDS + 1}) t(seed))"""


@query(f"""WITH RECURSIVE {_units_sql()}, {_GROUPS}, {_CHANCE}, {_match_sql(f'SELECT session_id * 10 + seed AS session_id, bin FROM ge, range(1, {SEEDS + 1}) t(seed)', 'SELECT * FROM rb')},
t AS (SELECT session_id % 10 AS seed, tol, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_pred) AS BIGINT) AS n_pred FROM sc GROUP BY 1, 2), f AS (SELECT *, {_PRF} FROM t)
SELECT *, round(avg(f1) OVER (PARTITION BY tol), 6) AS mean_f1, round(max(f1) OVER (PARTITION BY tol) - min(f1) OVER (PARTITION BY tol), 6) AS spread FROM f""")
def chance_segmenter(spark, sf_dir):
    """Boundaries drawn by a hash, exactly as many in a session as the prediction has: what chance scores, a row a seed
    and tolerance, with the mean and the range of F1 over the seeds."""
    bounds, large = _bounds(spark, sf_dir), large_sessions(spark, sf_dir)
    seeds = F.explode(F.sequence(F.lit(1), F.lit(SEEDS))).alias("seed")
    gold = _edge_rows(_units(spark, sf_dir), bounds).select("session_id", "bin", seeds)
    counts = _edge_rows(_pred(spark, sf_dir), bounds).groupBy("session_id").agg(F.count("*").alias("np"))
    drawn = S.drawn_bins(counts.join(bounds.select("session_id", F.ceil((F.col("t1") - F.col("t0")) / HOUR).alias("n")), "session_id"), "session_id", SEEDS, large)
    keys = bounds.select("session_id", seeds)
    sc = S.matched_boundaries(gold, drawn, keys, ["session_id", "seed"], (2, 5, 10), large=large)
    t = sc.groupBy(F.col("seed").cast("bigint").alias("seed"), "tol").agg(*[F.sum(c).alias(c) for c in ("tp", "n_gold", "n_pred")])
    t = t.withColumns(S.prf(F.col("tp"), F.col("n_gold"), F.col("n_pred")))
    w = Window.partitionBy("tol")  # a row a seed
    return t.withColumns({"mean_f1": F.round(F.avg("f1").over(w), 6), "spread": F.round(F.max("f1").over(w) - F.min("f1").over(w), 6)})


_PLACED = """gp AS (SELECT p.session_id, start_ts, end_ts - start_ts AS d, start_ts - coalesce(lag(end_ts) OVER w, t0) AS gap, t0, row_number() OVER w AS i, row_number() OVER (PARTITION BY p.session_id ORDER BY md5(concat_ws('-', p.session_id, start_ts)), start_ts) AS r FROM pred p JOIN bd USING (session_id) WINDOW w AS (PARTITION BY p.session_id ORDER BY start_ts, end_ts)),
pl AS (SELECT x.session_id, x.t0 + sum(x.gap) OVER w + coalesce(sum(y.d) OVER (PARTITION BY x.session_id ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ts, x.t0 + sum(x.gap) OVER w + sum(y.d) OVER w AS end_ts FROM gp x JOIN gp y ON y.session_id = x.session_id AND y.r = x.i WINDOW w AS (PARTITION BY x.session_id ORDER BY x.i))"""


@query(f"WITH RECURSIVE {_units_sql()}, {_GROUPS}, {_BDS}, {_PLACED}, {_match_sql(_EDGES.format('units'), _EDGES.format('pl'))}, t AS (SELECT tol, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_pred) AS BIGINT) AS n_pred FROM sc GROUP BY 1) SELECT *, {_PRF} FROM t")
def chance_placement(spark, sf_dir):
    """The predicted units of a session in another order (by a hash), with the gaps as they were: what their lengths alone score."""
    bounds, w = _bounds(spark, sf_dir), Window.partitionBy("session_id").orderBy("start_ts", "end_ts")
    p = _pred(spark, sf_dir).join(bounds, "session_id")
    mixed = Window.partitionBy("session_id").orderBy(F.md5(F.concat_ws("-", F.col("session_id").cast("string"), F.col("start_ts").cast("string")).cast("binary")), "start_ts")
    p = p.select(
        "session_id", "t0", (F.col("end_ts") - F.col("start_ts")).alias("d"), (F.col("start_ts") - F.coalesce(F.lag("end_ts").over(w), F.col("t0"))).alias("gap"), F.row_number().over(w).alias("i"), F.row_number().over(mixed).alias("r")
    )
    order = Window.partitionBy("session_id").orderBy("i")
    p = p.select("session_id", "t0", "gap", "i").join(p.select("session_id", F.col("r").alias("i"), "d"), ["session_id", "i"])
    start = F.col("t0") + F.sum("gap").over(order) + F.sum("d").over(order) - F.col("d")
    placed = p.select("session_id", start.alias("start_ts"), (start + F.col("d")).alias("end_ts"))
    sc = S.matched_boundaries(_edge_rows(_units(spark, sf_dir), bounds), _edge_rows(placed, bounds), bounds, ["session_id"], (2, 5, 10), large=large_sessions(spark, sf_dir))
    t = sc.groupBy("tol").agg(*[F.sum(c).alias(c) for c in ("tp", "n_gold", "n_pred")])
    return t.withColumns(S.prf(F.col("tp"), F.col("n_gold"), F.col("n_pred")))


@query(f"""WITH {_units_sql()}, {_GROUPS}, {_BDS}, g AS (SELECT session_id, list(bin ORDER BY bin) AS g FROM ({_EDGES.format('units')}) GROUP BY 1), p AS (SELECT session_id, list(bin ORDER BY bin) AS p FROM ({_EDGES.format('pred')}) GROUP BY 1),
xg AS (SELECT session_id, unnest(g) AS gb, unnest(generate_series(1, len(g))) AS i FROM g), yp AS (SELECT session_id, unnest(p) AS pb, unnest(generate_series(1, len(p))) AS j FROM p),
c AS (SELECT session_id, list(struct_pack(d := abs(gb - pb), i := i, j := j) ORDER BY abs(gb - pb), i, j) AS c FROM xg JOIN yp USING (session_id) WHERE abs(gb - pb) <= 5 GROUP BY 1),
f AS (SELECT session_id, list_reduce(list_transform(c, lambda z: struct_pack(g := [z.i], p := [z.j])), lambda s, z: CASE WHEN list_contains(s.g, z.g[1]) OR list_contains(s.p, z.p[1]) THEN s ELSE struct_pack(g := list_concat(s.g, z.g), p := list_concat(s.p, z.p)) END) AS f FROM c)
SELECT bd.session_id, CAST(coalesce(len(f.g), 0) AS INTEGER) AS tp FROM bd LEFT JOIN f USING (session_id)""")
def nearest_first(spark, sf_dir):
    """The superseded matcher that takes the nearest pairs first, for comparison; its pairs are those within the tolerance."""
    bounds = _bounds(spark, sf_dir)
    gold = _edges(_units(spark, sf_dir), bounds).withColumnRenamed("bins", "g")
    pred = _edges(_pred(spark, sf_dir), bounds).withColumnRenamed("bins", "p")
    both = bounds.join(gold, "session_id", "left").join(pred, "session_id", "left")
    return both.select("session_id", F.coalesce(S.nearest_first_matches(F.col("g"), F.col("p"), 5), F.lit(0)).alias("tp"))


@query(_PAIRS + """, n AS (SELECT u.session_id, u.start_ts, u.end_ts, count(ps) AS any_overlap, count(*) FILTER (10 * overlap >= ge - gs) AS material, coalesce(max(overlap), 0) / (u.end_ts - u.start_ts) AS best FROM units u
LEFT JOIN o ON o.session_id = u.session_id AND gs = u.start_ts AND ge = u.end_ts GROUP BY 1, 2, 3) SELECT count(*) AS units, round(100.0 * count(*) FILTER (any_overlap = 1) / count(*), 4) AS one_any, round(100.0 * count(*) FILTER (material = 1) / count(*), 4) AS one_material,
round(100.0 * count(*) FILTER (best >= 0.8) / count(*), 4) AS mostly_covered, round(quantile_cont(best, 0.5), 6) AS median_coverage FROM n""")
def bijection_summary(spark, sf_dir):
    """Units that meet one predicted unit, one for a tenth of them at least, and how far the best one covers them."""
    units = _units(spark, sf_dir).select("session_id", F.col("start_ts").alias("gs"), F.col("end_ts").alias("ge"))
    pairs = I.overlaps(_units(spark, sf_dir), _pred(spark, sf_dir), "session_id")
    length = F.col("ge") - F.col("gs")
    n = units.join(pairs, ["session_id", "gs", "ge"], "left").groupBy("session_id", "gs", "ge").agg(
        F.count("ps").alias("met"), F.count_if(10 * F.col("overlap") >= length).alias("material"), F.coalesce(F.max("overlap"), F.lit(0)).alias("best")
    )
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    best = F.col("best") / length
    n = n.withColumn("cover", best)
    return n.agg(
        F.count("*").alias("units"), share(F.col("met") == 1).alias("one_any"), share(F.col("material") == 1).alias("one_material"), share(F.col("cover") >= 0.8).alias("mostly_covered"),
        F.round(F.expr("percentile(cover, 0.5)"), 6).alias("median_coverage"),
    )


def _agreement_sql(by: str, rows: str) -> str:
    """Grouped V-measure and adjusted Rand index of (by, a, b) rows."""
    return f"""ct AS (SELECT {by}, a, b, count(*) AS n FROM ({rows}) GROUP BY ALL), cw AS (SELECT *, sum(n) OVER (PARTITION BY {by}, a) AS na, sum(n) OVER (PARTITION BY {by}, b) AS nb, sum(n) OVER (PARTITION BY {by}) AS t FROM ct),
cs AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT b) AS clusters, -sum(n / t * ln(n / nb)) AS hab, -sum(n / t * ln(n / na)) AS hba, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb,
 sum(n * (n - 1) / 2) AS s, sum(n * (na - 1) / 2) AS sa, sum(n * (nb - 1) / 2) AS sb FROM cw GROUP BY {by}),
ch AS (SELECT *, CASE WHEN ha < 1e-15 THEN 1.0 ELSE 1 - hab / ha END AS h, CASE WHEN hb < 1e-15 THEN 1.0 ELSE 1 - hba / hb END AS k, sa * sb / greatest(CAST(n AS DOUBLE) * (n - 1) / 2, 1.0) AS chance FROM cs),
ag AS (SELECT {by}, n, clusters, round(CASE WHEN h + k < 1e-12 THEN 0 ELSE 2 * h * k / (h + k) END, 6) AS v_measure, round(CASE WHEN abs((sa + sb) / 2 - chance) < 1e-12 THEN 1.0 ELSE (s - chance) / ((sa + sb) / 2 - chance) END, 6) AS adjusted_rand FROM ch)"""


_DRAWS = """dd AS (SELECT doc_id, lang, quality, draw FROM documents JOIN labels USING (doc_id), range(1, 6) t(draw) WHERE lang IS NOT NULL AND quality IS NOT NULL),
ra AS (SELECT draw, quality, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('-', draw, 'a', doc_id)), doc_id) AS r FROM dd), rb AS (SELECT draw, lang, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('-', draw, 'b', doc_id)), doc_id) AS r FROM dd)"""


def _marked(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")
    return d.where("lang is not null and quality is not null")


@query(f"WITH {_DRAWS}, {_agreement_sql('draw', 'SELECT draw, lang AS a, quality AS b FROM ra JOIN rb USING (draw, r)')} SELECT CAST(draw AS INTEGER) AS draw, n, clusters, v_measure, adjusted_rand FROM ag")
def label_shuffle_chance(spark, sf_dir):
    """Agreement of two labellings after one of them was dealt anew, in five draws."""
    d = _marked(spark, sf_dir)
    dealt = S.shuffled(d, "doc_id", "lang", 5).join(d.select("doc_id", "quality"), "doc_id")
    return S.grouped_agreement(dealt, ["draw"], "lang", "quality")


# the SQL deals the labels of one rank order to the other's; so does ``shuffled``: both name the same pairs
@query(f"""WITH {_DRAWS}, c AS (SELECT draw, quality, lang, count(*) AS n FROM ra JOIN rb USING (draw, r) GROUP BY ALL UNION ALL SELECT 0, quality, lang, count(*) FROM dd WHERE draw = 1 GROUP BY ALL),
m AS (SELECT draw, quality, max(n) AS top, sum(n) AS n FROM c GROUP BY 1, 2), w AS (SELECT draw, sum(top) / sum(n) AS agreement FROM m GROUP BY 1)
SELECT round(max(agreement) FILTER (draw = 0), 6) AS agreement, round(avg(agreement) FILTER (draw > 0), 6) AS chance FROM w""")
def purity_and_chance(spark, sf_dir):
    """Share of rows whose label is the most frequent one of their class, and the mean of that over shuffled labels."""
    d = _marked(spark, sf_dir)
    dealt = S.shuffled(d, "doc_id", "lang", 5).join(d.select("doc_id", "quality"), "doc_id").select("draw", "lang", "quality")
    rows = dealt.unionByName(d.select(F.lit(0).alias("draw"), "lang", "quality"))
    n = rows.groupBy("draw", "quality", "lang").agg(F.count("*").alias("n")).groupBy("draw", "quality").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    w = n.groupBy("draw").agg((F.sum("top") / F.sum("n")).alias("a"))
    return w.agg(F.round(F.max(F.when(F.col("draw") == 0, F.col("a"))), 6).alias("agreement"), F.round(F.avg(F.when(F.col("draw") > 0, F.col("a"))), 6).alias("chance"))


@query()
def permutation_test(spark, sf_dir):
    """Whether each language's share of good documents differs from the rest's: 5,000 permutations a test, with
    Bonferroni's correction over the tests.  Random draws have no SQL; a test compares p with the exact tail."""
    return U.permutation_tests(_marked(spark, sf_dir), "lang", "quality", draws=5000)


_NEXT = f"""nx AS (SELECT *, (SELECT min(q.t) FROM a q WHERE q.session_id = a.session_id AND q.event_type = 'view' AND q.t >= a.t) AS vt FROM a WHERE event_type = 'purchase'),
nv AS (SELECT nx.session_id, nx.event_id, nx.k % 5 AS a, v.k % 5 AS b, v.t - nx.t AS d FROM nx JOIN a v ON v.session_id = nx.session_id AND v.t = vt AND v.event_type = 'view')"""


@query(f"""WITH {_A}, {_NEXT}, tl AS (SELECT * FROM (VALUES (2), (5), (10), (100000)) t(hours)), {_agreement_sql('hours', f'SELECT hours, a, b FROM nv, tl WHERE d <= CAST(hours AS BIGINT) * {HOUR}')} SELECT * FROM ag""")
def held_out_tolerances(spark, sf_dir):
    """Agreement of a label with the next independent observation, by how soon that must follow."""
    from .operators.grid import asof

    a = activity(spark, sf_dir)
    views = a.where("event_type = 'view'").select("session_id", F.col("t").alias("at"), F.col("k").alias("value"))
    p = asof(a.where("event_type = 'purchase'").select("session_id", "event_id", "t", "k"), "session_id", "t", views, "at", "value").where("after is not null")
    p = p.select((F.col("k") % 5).alias("a"), (F.col("after.value") % 5).alias("b"), (F.col("after.at") - F.col("t")).alias("d"))
    hours = F.explode(F.array(*[F.lit(h) for h in (2, 5, 10, 100_000)]))
    rows = p.withColumn("hours", hours).where(F.col("d") <= F.col("hours").cast("bigint") * HOUR)
    return S.grouped_agreement(rows, ["hours"], "a", "b")


#: Settings of the ablation: number, name, reach in hours, whether openings count, most hours of widening.
_SETTINGS = [(1, "shipped", 48, True, 12), (2, "no openings", 48, False, 12), (3, "short reach", 12, True, 12), (4, "no widening", 48, True, 0), (5, "wide", 48, True, 24)]
_ABLATED = f"""cf AS (SELECT * FROM (VALUES {', '.join(f"({no}, '{name}', {reach}, {str(opens).lower()}, {cap})" for no, name, reach, opens, cap in _SETTINGS)}) t(no, setting, reach, opens, cap)),
aw AS (SELECT *, max(CASE WHEN event_type = 'view' THEN t END) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, min(t) OVER (PARTITION BY session_id) AS t0,
  {', '.join(f"min(t) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN {r * HOUR} PRECEDING AND CURRENT ROW) AS f{r}" for r in sorted({s[2] for s in _SETTINGS}))} FROM a),
ad AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY session_id ORDER BY t), t0) AS prev FROM aw WHERE event_type = 'purchase'),
ax AS (SELECT session_id, no, cap, t, lo, prev, coalesce(opens AND lo >= greatest(prev, t - reach * CAST({HOUR} AS BIGINT)), false) AS has_open, CASE reach {' '.join(f"WHEN {r} THEN f{r}" for r in sorted({s[2] for s in _SETTINGS}))} END AS f FROM ad, cf),
au AS (SELECT * FROM (SELECT session_id, no, cap, CASE WHEN has_open THEN lo ELSE greatest(prev, f) END AS s, t AS e FROM ax) WHERE e - s >= {MIN_UNIT}),
ae AS (SELECT u.session_id, no, s, e, greatest(0, least(floor((s - coalesce(lag(e) OVER w, t0)) / 2), cap * CAST({HOUR} AS BIGINT))) AS bk, greatest(0, least(floor((coalesce(lead(s) OVER w, t1) - e) / 2), cap * CAST({HOUR} AS BIGINT))) AS fw
  FROM au u JOIN b0 USING (session_id) WINDOW w AS (PARTITION BY no, u.session_id ORDER BY s, e)),
wu AS (SELECT session_id, no, CAST(s - bk AS BIGINT) AS start_ts, CAST(e + fw AS BIGINT) AS end_ts FROM ae),
we AS (SELECT DISTINCT session_id * 10 + no AS session_id, bin FROM (SELECT session_id, no, unnest([floor((start_ts - t0) / {HOUR}), ceil((end_ts - t0) / {HOUR})]) AS bin, ceil((t1 - t0) / {HOUR}) AS n FROM wu JOIN b0 USING (session_id)) WHERE bin > 0 AND bin < n),
bd AS (SELECT session_id * 10 + no AS session_id FROM b0, cf),
iv AS (SELECT wu.no, gg.session_id, gg.event_id, gg.no AS grp, min((wu.start_ts, wu.end_ts)) AS u FROM gg JOIN wu ON wu.session_id = gg.session_id AND gg.t BETWEEN wu.start_ts AND wu.end_ts GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_A}, {_GROUPS}, {_B0}, {_ABLATED}, pe AS ({_EDGES0.format('pred')}), {_match_sql('SELECT session_id * 10 + no AS session_id, bin FROM pe, cf', 'SELECT * FROM we', (5,))},
t AS (SELECT session_id % 10 AS no, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_pred) AS BIGINT) AS n_pred FROM sc GROUP BY 1), {_agreement_sql('no', "SELECT no, concat_ws('-', session_id, grp) AS a, concat_ws('-', session_id, u[1]) AS b FROM iv")}
SELECT setting, tp, n_gold, n_pred, {_PRF}, n AS events, clusters, v_measure, adjusted_rand FROM t JOIN cf USING (no) JOIN ag USING (no)""")
def ablations(spark, sf_dir):
    """Settings of the recovery against its scores: widened units against the gap sessions, by boundaries (within 5 bins)
    and by the agreement of the events' units with their sessions; all settings go through each step together."""
    a, bounds, large = activity(spark, sf_dir), _bounds(spark, sf_dir), large_sessions(spark, sf_dir)
    kind = F.col("event_type")
    settings = [{"name": name, "reach": reach * HOUR, "opens": opens, "cap": cap * HOUR} for _, name, reach, opens, cap in _SETTINGS]
    units = B.bracket_settings(a, "session_id", "t", kind == "view", kind == "purchase", settings, MIN_UNIT)
    run = F.struct("setting", "cap", "session_id").alias("run")
    names = F.explode(F.array(*[F.struct(F.lit(s["name"]).alias("setting"), F.lit(s["cap"]).cast("bigint").alias("cap")) for s in settings])).alias("x")
    every = bounds.select("*", names).select("*", "x.*")
    wide = B.expand(units.select(run, "start_ts", "end_ts"), every.select(run, "t0", "t1"), "run", F.col("run.cap"), large=None if large is None else "count")
    wide = keep(wide.select("run.setting", "run.session_id", F.col("wide_start").alias("start_ts"), F.col("wide_end").alias("end_ts")), "ablations")
    bins = F.array(F.floor((F.col("start_ts") - F.col("t0")) / HOUR), F.ceil((F.col("end_ts") - F.col("t0")) / HOUR))
    e = wide.join(bounds, "session_id").select("setting", "session_id", F.explode(bins).alias("bin"), F.ceil((F.col("t1") - F.col("t0")) / HOUR).alias("n"))
    e = e.where("bin > 0 and bin < n").select("setting", "session_id", "bin")
    gold = _edge_rows(_pred(spark, sf_dir), bounds).select("session_id", "bin", names).select("x.setting", "session_id", "bin")
    sc = S.matched_boundaries(gold, e, every, ["setting", "session_id"], (5,), large=large)
    t = sc.groupBy("setting").agg(*[F.sum(c).alias(c) for c in ("tp", "n_gold", "n_pred")]).withColumns(S.prf(F.col("tp"), F.col("n_gold"), F.col("n_pred")))
    groups = Q.gap_sessions(a.where("event_type <> 'error'"), ["session_id"], "t", GAP, ["event_id"])
    inside = I.containment(wide, groups.select("session_id", "t", "event_id", "group_no"), "session_id", "t", how="inner")
    first = inside.groupBy("setting", "session_id", "event_id", "group_no").agg(F.min(F.struct("start_ts", "end_ts")).alias("u"))
    rows = first.select("setting", F.concat_ws("-", "session_id", "group_no").alias("a"), F.concat_ws("-", "session_id", "u.start_ts").alias("b"))
    return t.join(S.grouped_agreement(rows, ["setting"], "a", "b").withColumnRenamed("n", "events"), "setting")


_PARTS = {"status": "o_orderstatus", "priority": "o_orderpriority", "year": "y", "quarter": "q", "nation": "nation"}
_SUBSETS = [[p for i, p in enumerate(_PARTS) if bits >> i & 1] for bits in range(1, 1 << len(_PARTS))]
_SIG = " UNION ALL ".join("SELECT '{}' AS signature, a, concat_ws('|', {}) AS b FROM o".format("+".join(s), ", ".join(_PARTS[p] for p in s)) for s in _SUBSETS)


@query(f"""WITH o AS (SELECT c_mktsegment AS a, o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(quarter(o_orderdate) AS VARCHAR) AS q, CAST(c_nationkey AS VARCHAR) AS nation FROM orders JOIN customer ON c_custkey = o_custkey),
{_agreement_sql('signature', _SIG)} SELECT *, row_number() OVER (ORDER BY v_measure DESC, clusters, signature) AS place FROM ag""")
def signature_search(spark, sf_dir):
    """How well each subset of five columns names a class, best first (the smaller on a tie).

    Rows are counted once, by all columns; the subsets are grouping sets of these counts."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(
        F.col("c_mktsegment").alias("a"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("string").alias("year"),
        F.quarter("o_orderdate").cast("string").alias("quarter"), F.col("c_nationkey").cast("string").alias("nation"),
    )
    parts = list(_PARTS)
    finest = o.groupBy("a", *parts).agg(F.count("*").alias("m"))
    named = F.concat_ws("+", *[F.when(F.grouping(p) == 0, F.lit(p)) for p in parts])
    sets = finest.groupingSets([["a", *s] for s in _SUBSETS], "a", *parts).agg(F.sum("m").alias("m"), named.alias("signature"))
    rows = sets.select("signature", "a", F.concat_ws("|", *parts).alias("b"), "m")
    order = Window.orderBy(F.desc("v_measure"), "clusters", "signature")  # a row a subset
    return S.grouped_agreement(rows, ["signature"], "a", "b", "m").withColumn("place", F.row_number().over(order).cast("bigint"))


_COMBOS = [(m, n) for m in (12, 24, 48) for n in (1, 60)]
_SWEEP = " UNION ALL ".join(
    f"SELECT {m} AS max_hours, {n} AS min_minutes, count(*) AS units, CAST(sum(t - s) AS BIGINT) AS spent FROM (SELECT t, greatest(prev, (SELECT min(t) FROM a q WHERE q.session_id = d.session_id AND q.t BETWEEN d.t - {m * HOUR} AND d.t)) AS s FROM d) WHERE t - s >= {n * 60_000_000}"
    for m, n in _COMBOS
)


@query(f"""WITH {_A}, d AS (SELECT session_id, t, coalesce(lag(t) OVER (PARTITION BY session_id ORDER BY t), (SELECT min(t) FROM a q WHERE q.session_id = a.session_id)) AS prev FROM a WHERE event_type = 'purchase') {_SWEEP}""")
def unit_sweep(spark, sf_dir):
    """Number and time of units (without openings) for several reaches and least lengths, in one pass."""
    order = Window.partitionBy("session_id").orderBy("t")
    a = activity(spark, sf_dir)
    reaches = sorted({m for m, _ in _COMBOS})
    for m in reaches:
        a = a.withColumn(f"f{m}", F.min("t").over(order.rangeBetween(-m * HOUR, 0)))
    a = a.withColumn("t0", F.min("t").over(Window.partitionBy("session_id"))).where("event_type = 'purchase'").withColumn("prev", F.coalesce(F.lag("t").over(order), F.col("t0")))
    combos = F.explode(F.array(*[F.struct(F.lit(m).alias("max_hours"), F.lit(n).alias("min_minutes"), F.greatest("prev", f"f{m}").alias("s")) for m, n in _COMBOS])).alias("c")
    u = a.select("t", combos).where(F.col("t") - F.col("c.s") >= F.col("c.min_minutes").cast("bigint") * 60_000_000)
    return u.groupBy("c.max_hours", "c.min_minutes").agg(F.count("*").alias("units"), F.sum(F.col("t") - F.col("c.s")).alias("spent"))


@query(f"""WITH {_units_sql()}, c AS (SELECT session_id, event_id, t, u.start_ts, u.end_ts, row_number() OVER (PARTITION BY a.session_id, event_id ORDER BY u.start_ts, u.end_ts) AS rn FROM a LEFT JOIN (SELECT session_id AS us, start_ts, end_ts FROM units) u ON us = a.session_id AND t BETWEEN u.start_ts AND u.end_ts)
SELECT count(*) AS events, count(start_ts) AS inside, count(*) - count(start_ts) AS outside, round(count(start_ts) / count(*), 6) AS share, round(quantile_cont((t - start_ts) / greatest(end_ts - start_ts, 1), 0.5), 6) AS median_position FROM c WHERE rn = 1""")
def inside_summary(spark, sf_dir):
    """Events inside and outside of units, and the median place of those inside in their first unit."""
    a = activity(spark, sf_dir)
    inside = I.containment(_units(spark, sf_dir), a.select("session_id", "t", "event_id"), "session_id", "t", how="inner")
    first = inside.groupBy("session_id", "event_id", "t").agg(F.min(F.struct("start_ts", "end_ts")).alias("u"))
    pos = (F.col("t") - F.col("u.start_ts")) / F.greatest(F.col("u.end_ts") - F.col("u.start_ts"), F.lit(1))
    n = first.withColumn("pos", pos).agg(F.count("*").alias("inside"), F.expr("percentile(pos, 0.5)").alias("m"))
    return a.agg(F.count("*").alias("events")).crossJoin(n).select("events", "inside", (F.col("events") - F.col("inside")).alias("outside"), F.round(F.col("inside") / F.col("events"), 6).alias("share"), F.round("m", 6).alias("median_position"))  # one row each


_TWO = """bk AS (SELECT count(*) AS n, CAST(sum(end_ts - start_ts) AS BIGINT) AS spent, count(DISTINCT session_id) AS sessions FROM ({}))"""


@query(f"""WITH {_units_sql()}, x2 AS (SELECT session_id, greatest(prev, f) AS start_ts, t AS end_ts FROM d WHERE t - greatest(prev, f) >= {MIN_UNIT}), y AS (SELECT count(*) AS n, CAST(sum(end_ts - start_ts) AS BIGINT) AS spent, count(DISTINCT session_id) AS sessions FROM units),
z AS (SELECT count(*) AS n, CAST(sum(end_ts - start_ts) AS BIGINT) AS spent, count(DISTINCT session_id) AS sessions FROM x2), b AS (SELECT unnest(['no fewer units', 'less time', 'same sessions']) AS name, unnest([y.n >= z.n, y.spent < z.spent, y.sessions = z.sessions]) AS ok FROM y, z)
SELECT name, ok, (SELECT bool_and(ok) FROM b) AS accepted FROM b""")
def acceptance_bar(spark, sf_dir):
    """Named comparisons, fixed beforehand, of units with openings against those without, and the verdict on all of them."""
    one = lambda opens: _units(spark, sf_dir, opens).agg(F.count("*").alias("n"), F.sum(F.col("end_ts") - F.col("start_ts")).alias("spent"), F.count_distinct("session_id").alias("sessions"))
    y, z = one(True).alias("y"), one(False).alias("z")
    return U.accepted(y.crossJoin(z), {"no fewer units": F.col("y.n") >= F.col("z.n"), "less time": F.col("y.spent") < F.col("z.spent"), "same sessions": F.col("y.sessions") == F.col("z.sessions")})  # one row each


@query("""WITH w AS (SELECT * FROM (VALUES ('regions', 5.0, true), ('nations', 25.0, true), ('lines an order', 4.0, false)) t(name, written, exact)),
s AS (SELECT 'regions' AS name, CAST(count(*) AS DOUBLE) AS actual FROM region UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'lines an order', (SELECT count(*) FROM lineitem) / (SELECT count(*) FROM orders))
SELECT name, written, actual, CASE WHEN exact THEN actual = written ELSE actual BETWEEN written / 2 AND 2 * written END AS ok FROM w JOIN s USING (name)""")
def reconcile(spark, sf_dir):
    """Written figures against those derived anew: exact, or within a factor of two."""
    n = lambda t: table(spark, sf_dir, t).agg(F.count("*").cast("double").alias("actual"))
    lines = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("l")).crossJoin(table(spark, sf_dir, "orders").agg(F.count("*").alias("o"))).select((F.col("l") / F.col("o")).alias("actual"))
    rows = [(n("region"), "regions", 5.0, True), (n("nation"), "nations", 25.0, True), (lines, "lines an order", 4.0, False)]
    out = None
    for df, name, written, exact in rows:
        ok = (F.col("actual") == written) if exact else F.col("actual").between(written / 2, 2 * written)
        one = df.select(F.lit(name).alias("name"), F.lit(written).alias("written"), "actual", ok.alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_units_sql()}, s AS (SELECT *, lead(start_ts) OVER (PARTITION BY session_id ORDER BY start_ts, end_ts) AS nx FROM units), c AS (SELECT 'rows' AS name, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS bad FROM units UNION ALL SELECT 'positive', count(*) FROM units WHERE end_ts <= start_ts
UNION ALL SELECT 'no overlap', count(*) FROM s WHERE nx < end_ts UNION ALL SELECT 'in session', count(*) FROM units JOIN (SELECT session_id, min(t) AS t0, max(t) AS t1 FROM a GROUP BY 1) USING (session_id) WHERE start_ts < t0 OR end_ts > t1
UNION ALL SELECT 'known sessions', count(*) FROM (SELECT session_id FROM units EXCEPT SELECT session_id FROM a) UNION ALL SELECT 'within reach', count(*) FROM units WHERE end_ts - start_ts > {MAX_UNIT} AND NOT has_open) SELECT name, CAST(bad AS BIGINT) AS bad, bad = 0 AS ok FROM c""")
def analysis_checks(spark, sf_dir):
    """Six invariants of the units, each with the number of rows that break it."""
    bounds = _bounds(spark, sf_dir)
    nx = F.lead("start_ts").over(Window.partitionBy("session_id").orderBy("start_ts", "end_ts"))
    u = _units(spark, sf_dir).withColumn("nx", nx).join(bounds, "session_id", "left")
    bad = {
        "positive": F.expr("end_ts <= start_ts"), "no overlap": F.expr("nx < end_ts"), "in session": F.expr("start_ts < t0 or end_ts > t1"),
        "known sessions": F.col("t0").isNull(), "within reach": (F.col("end_ts") - F.col("start_ts") > MAX_UNIT) & ~F.col("has_open"),
    }
    one = u.agg((F.when(F.count("*") == 0, 1).otherwise(0)).cast("bigint").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items()])
    return one.unpivot([], ["rows", *bad], "name", "bad").withColumn("ok", F.col("bad") == 0)
