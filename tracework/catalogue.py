"""The registered queries of the process-mining operators, with the DuckDB SQL of each.

The driver's ``events`` play the roles of an activity log (see ``sources.event_log.activity``); times are
microseconds, and the seconds of a desktop log become hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.text import case_ids, case_prefix
from .operators import brackets as B
from .operators import intervals as I
from .operators import rules as R
from .operators import scoring as S
from .operators import sequence as Q
from .operators.scan import large_keys
from .sources.event_log import activity, table

HOUR = 3_600_000_000
GAP, MAX_UNIT, MIN_UNIT, CAP, SNAP = 6 * HOUR, 48 * HOUR, 60_000_000, 12 * HOUR, 3 * HOUR
RULES = [(50_000, "<", "team"), (50_000, ">=", "director"), (200_000, ">=", "board")]

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: The activity log, and its bracketed units, in SQL.
_A = "a AS (SELECT user_id AS session_id, epoch_us(ts) AS t, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def _units_sql(opens: bool = True) -> str:
    return f"""{_A},
w AS (SELECT *, max(CASE WHEN event_type = 'view' THEN t END) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
  min(t) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN {MAX_UNIT} PRECEDING AND CURRENT ROW) AS f, min(t) OVER (PARTITION BY session_id) AS t0 FROM a),
d AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY session_id ORDER BY t), t0) AS prev FROM w WHERE event_type = 'purchase'),
x AS (SELECT session_id, coalesce({'true' if opens else 'false'} AND lo >= greatest(prev, t - {MAX_UNIT}), false) AS has_open, lo, prev, f, t FROM d),
units AS (SELECT * FROM (SELECT session_id, CASE WHEN has_open THEN lo ELSE greatest(prev, f) END AS start_ts, t AS end_ts, has_open FROM x) WHERE end_ts - start_ts >= {MIN_UNIT})"""


def large_sessions(spark, sf_dir) -> DataFrame | None:
    """Sessions that windows have to cut."""
    return large_keys(activity(spark, sf_dir), ["session_id"])


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _units(spark, sf_dir: str, opens: bool = True) -> DataFrame:
    a = activity(spark, sf_dir)
    kind = F.col("event_type")
    return B.bracket_pairs(a, "session_id", "t", kind == "view", kind == "purchase", MAX_UNIT, MIN_UNIT, opens)


@query(f"""WITH {_A}, l AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t, event_id) > {GAP} THEN 1 ELSE 0 END AS f FROM a WHERE event_type <> 'error'),
g AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY t, event_id) + 1 AS group_no FROM l)
SELECT session_id, CAST(group_no AS BIGINT) AS group_no, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM g GROUP BY 1, 2""")
def gap_sessions(spark, sf_dir):
    a = activity(spark, sf_dir).where("event_type <> 'error'")
    g = Q.gap_sessions(a, ["session_id"], "t", GAP, ["event_id"])
    return g.groupBy("session_id", "group_no").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"))


@query(f"""WITH {_A}, l AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY session_id ORDER BY t, event_id) THEN 1 ELSE 0 END AS f FROM a),
g AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY t, event_id) + 1 AS group_no FROM l)
SELECT session_id, CAST(group_no AS BIGINT) AS group_no, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY 1, 2""")
def app_change_runs(spark, sf_dir):
    g = Q.change_runs(activity(spark, sf_dir), ["session_id"], ["t", "event_id"], "event_type")
    return g.groupBy("session_id", "group_no").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query(f"WITH {_A} SELECT session_id, min(t) AS t0, max(t) AS t1 FROM a GROUP BY 1")
def session_bounds(spark, sf_dir):
    return B.bounds(activity(spark, sf_dir), "session_id", "t")


@query(f"""WITH {_A}, s AS (SELECT *, CASE WHEN event_type = 'view' THEN k END AS v FROM a)
SELECT session_id, event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS state FROM s""")
def ffill_state(spark, sf_dir):
    a = activity(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "view", F.col("k")))
    return Q.fill(a, ["session_id"], ["t", "event_id"], "v", "state").select("session_id", "event_id", "state")


_NEAR = f"""WITH {_A}, m AS (SELECT *, CASE WHEN event_type IN ('click', 'signup') THEN t END AS q FROM a),
n AS (SELECT session_id, event_id, t, max(q) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
  max(q) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS strictly_before,
  min(q) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM m)"""


@query(_NEAR + " SELECT session_id, event_id, before, strictly_before, after FROM n")
def asof_neighbours(spark, sf_dir):
    a = activity(spark, sf_dir)
    n = Q.neighbours(a, ["session_id"], "t", F.col("event_type").isin("click", "signup"), ["event_id"])
    return n.select("session_id", "event_id", "before", "strictly_before", "after")


@query(_NEAR + f""", z AS (SELECT *, CASE WHEN before IS NULL THEN after WHEN after IS NULL THEN before WHEN t - before <= after - t THEN before ELSE after END AS near FROM n)
SELECT session_id, event_id, CASE WHEN abs(near - t) <= {SNAP} THEN near END AS snapped FROM z""")
def snap_to_transition(spark, sf_dir):
    a = activity(spark, sf_dir)
    n = Q.neighbours(a, ["session_id"], "t", F.col("event_type").isin("click", "signup"), ["event_id"])
    return n.select("session_id", "event_id", Q.nearest(F.col("t"), F.col("before"), F.col("after"), SNAP).alias("snapped"))


@query(f"WITH {_units_sql()} SELECT * FROM units")
def bracket_pairs(spark, sf_dir):
    return _units(spark, sf_dir)


@query(f"WITH {_units_sql(False)} SELECT * FROM units")
def bracket_v3(spark, sf_dir):
    return _units(spark, sf_dir, opens=False)


_WIDE = f"""WITH {_units_sql()}, b AS (SELECT session_id, min(t) AS t0, max(t) AS t1 FROM a GROUP BY 1),
e AS (SELECT u.session_id, start_ts, end_ts, greatest(0, least(floor((start_ts - coalesce(lag(end_ts) OVER w, t0)) / 2), {CAP})) AS bk,
  greatest(0, least(floor((coalesce(lead(start_ts) OVER w, t1) - end_ts) / 2), {CAP})) AS fw FROM units u JOIN b USING (session_id)
  WINDOW w AS (PARTITION BY u.session_id ORDER BY start_ts, end_ts)),
wide AS (SELECT session_id, start_ts, end_ts, CAST(start_ts - bk AS BIGINT) AS wide_start, CAST(end_ts + fw AS BIGINT) AS wide_end FROM e)"""


@query(_WIDE + " SELECT * FROM wide")
def bracket_expanded(spark, sf_dir):
    return B.expand(_units(spark, sf_dir), B.bounds(activity(spark, sf_dir), "session_id", "t"), "session_id", CAP, large=large_sessions(spark, sf_dir))


@query(_WIDE + """, c AS (SELECT u.session_id, u.start_ts, u.end_ts, k, count(*) AS n FROM units u JOIN a ON a.session_id = u.session_id AND a.t BETWEEN u.start_ts AND u.end_ts GROUP BY 1, 2, 3, 4),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session_id, start_ts, end_ts ORDER BY n DESC, k) = 1)
SELECT wide.*, m.k AS case_id FROM wide JOIN m USING (session_id, start_ts, end_ts)""")
def bracket_segments(spark, sf_dir):
    """The flagship: bracketed units, each with its modal case, widened to the middle of the gaps."""
    units, a = _units(spark, sf_dir), activity(spark, sf_dir)
    inside = I.containment(units, a.select("session_id", "t", "k"), "session_id", "t")
    case = inside.groupBy("session_id", "start_ts", "end_ts").agg(F.expr("mode(k, true)").alias("case_id"))
    return B.expand(units, B.bounds(a, "session_id", "t"), "session_id", CAP, large=large_sessions(spark, sf_dir)).join(case, ["session_id", "start_ts", "end_ts"])


@query(f"""WITH {_units_sql()} SELECT u.session_id, u.start_ts, u.end_ts, count(t) AS n_events, count(*) FILTER (event_type = 'click') AS n_clicks, count(DISTINCT event_type) AS n_types,
CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS any_error FROM units u LEFT JOIN a ON a.session_id = u.session_id AND t BETWEEN start_ts AND end_ts GROUP BY 1, 2, 3""")
def segment_event_counts(spark, sf_dir):
    inside = I.containment(_units(spark, sf_dir), activity(spark, sf_dir), "session_id", "t")
    return inside.groupBy("session_id", "start_ts", "end_ts").agg(
        F.count("t").alias("n_events"),
        F.count_if(F.col("event_type") == "click").alias("n_clicks"),
        F.count_distinct("event_type").alias("n_types"),
        F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("any_error"),
    )


_GROUPS = f"""gl AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t, event_id) > {GAP} THEN 1 ELSE 0 END AS f FROM a WHERE event_type <> 'error'),
gg AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY t, event_id) AS no FROM gl), pred AS (SELECT session_id, min(t) AS start_ts, max(t) AS end_ts FROM gg GROUP BY session_id, no)"""
_PAIRS = f"""WITH {_units_sql()}, {_GROUPS}, o AS (SELECT u.session_id, u.start_ts AS gs, u.end_ts AS ge, p.start_ts AS ps, p.end_ts AS pe, least(u.end_ts, p.end_ts) - greatest(u.start_ts, p.start_ts) AS overlap
FROM units u JOIN pred p ON u.session_id = p.session_id AND p.start_ts < u.end_ts AND p.end_ts > u.start_ts)"""


def _pred(spark, sf_dir):
    g = gap_sessions(spark, sf_dir)
    return g.select("session_id", F.col("start_t").alias("start_ts"), F.col("end_t").alias("end_ts"))


@query(_PAIRS + " SELECT * FROM o")
def overlap_join(spark, sf_dir):
    return I.overlaps(_units(spark, sf_dir), _pred(spark, sf_dir), "session_id")


@query(_PAIRS + " SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY session_id, gs, ge ORDER BY overlap DESC, ps, pe) = 1")
def max_overlap_match(spark, sf_dir):
    return I.best_overlap(I.overlaps(_units(spark, sf_dir), _pred(spark, sf_dir), "session_id"), "session_id")


@query(_PAIRS + """ SELECT u.session_id, u.start_ts AS gs, u.end_ts AS ge, count(ps) AS any_overlap, count(*) FILTER (10 * overlap >= ge - gs) AS material FROM units u
LEFT JOIN o ON o.session_id = u.session_id AND gs = u.start_ts AND ge = u.end_ts GROUP BY 1, 2, 3""")
def bijection_counts(spark, sf_dir):
    units = _units(spark, sf_dir).select("session_id", F.col("start_ts").alias("gs"), F.col("end_ts").alias("ge"))
    pairs = I.overlaps(_units(spark, sf_dir), _pred(spark, sf_dir), "session_id")
    return units.join(pairs, ["session_id", "gs", "ge"], "left").groupBy("session_id", "gs", "ge").agg(
        F.count("ps").alias("any_overlap"), F.count_if(10 * F.col("overlap") >= F.col("ge") - F.col("gs")).alias("material")
    )


@query(f"""WITH {_units_sql()}, s AS (SELECT *, row_number() OVER (PARTITION BY a.session_id, event_id ORDER BY start_ts, end_ts) AS rn FROM a JOIN (SELECT session_id AS us, start_ts, end_ts FROM units) u ON us = a.session_id AND t BETWEEN start_ts AND end_ts)
SELECT session_id, event_id, round((t - start_ts) / greatest(end_ts - start_ts, 1), 6) AS position FROM s WHERE rn = 1""")
def relative_position(spark, sf_dir):
    inside = I.containment(_units(spark, sf_dir), activity(spark, sf_dir), "session_id", "t", how="inner")
    w = Window.partitionBy("session_id", "event_id").orderBy("start_ts", "end_ts")
    pos = F.round((F.col("t") - F.col("start_ts")) / F.greatest(F.col("end_ts") - F.col("start_ts"), F.lit(1)), 6)
    return inside.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("session_id", "event_id", pos.alias("position"))


def _edge_rows(units, bounds):
    """Distinct hour bins of the edges of units, strictly inside their session."""
    bins = F.array(F.floor((F.col("start_ts") - F.col("t0")) / HOUR), F.ceil((F.col("end_ts") - F.col("t0")) / HOUR))
    e = units.join(bounds, "session_id").select("session_id", F.explode(bins).alias("bin"), F.ceil((F.col("t1") - F.col("t0")) / HOUR).alias("n"))
    return e.where("bin > 0 and bin < n").select("session_id", "bin").distinct()


def _edges(units, bounds):
    """The same as a sorted array a session, for comparators that need one."""
    return _edge_rows(units, bounds).groupBy("session_id").agg(F.sort_array(F.collect_set("bin")).alias("bins"))


_EDGES = "SELECT DISTINCT session_id, bin FROM (SELECT session_id, unnest([floor((start_ts - t0) / 3600000000), ceil((end_ts - t0) / 3600000000)]) AS bin, ceil((t1 - t0) / 3600000000) AS n FROM {} JOIN bd USING (session_id)) WHERE bin > 0 AND bin < n"


def _match_sql(gold: str, pred: str, tolerances=(2, 5, 10)) -> str:
    """CTEs g, p, r and ``sc``: matched boundaries of every session of bd and tolerance, by a recursive sweep."""
    tols = ", ".join(f"({t})" for t in tolerances)
    return f"""g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bin) AS i FROM ({gold})), p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bin) AS j FROM ({pred})), tl AS (SELECT * FROM (VALUES {tols}) t(tol)),
r AS (SELECT DISTINCT session_id, tol, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, 0 AS tp FROM g, tl UNION ALL
  SELECT r.session_id, tol, CASE WHEN p.bin < g.bin - tol THEN r.i ELSE r.i + 1 END, CASE WHEN p.bin > g.bin + tol THEN r.j ELSE r.j + 1 END, r.tp + CASE WHEN abs(p.bin - g.bin) <= tol THEN 1 ELSE 0 END
  FROM r JOIN g ON g.session_id = r.session_id AND g.i = r.i JOIN p ON p.session_id = r.session_id AND p.j = r.j),
sc AS (SELECT bd.session_id, tl.tol, coalesce((SELECT max(tp) FROM r WHERE r.session_id = bd.session_id AND r.tol = tl.tol), 0) AS tp, (SELECT count(*) FROM g WHERE g.session_id = bd.session_id) AS n_gold,
  (SELECT count(*) FROM p WHERE p.session_id = bd.session_id) AS n_pred FROM bd, tl)"""


_PRF = """round(CASE WHEN n_gold = 0 AND n_pred = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END, 6) AS precision, round(CASE WHEN n_gold = 0 AND n_pred = 0 THEN 1.0 WHEN n_gold = 0 THEN 0.0 ELSE tp / n_gold END, 6) AS recall,
round(CASE WHEN n_gold = 0 AND n_pred = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (n_gold + n_pred) END, 6) AS f1"""
_BDS = "bd AS (SELECT session_id, min(t) AS t0, max(t) AS t1 FROM a GROUP BY 1)"
_SCORED = f"WITH RECURSIVE {_units_sql()}, {_GROUPS}, {_BDS}, {_match_sql(_EDGES.format('units'), _EDGES.format('pred'))}"


def _scores(spark, sf_dir, tolerances=(2, 5, 10)) -> DataFrame:
    """Matched boundaries of the gap sessions against the bracketed units."""
    bounds = B.bounds(activity(spark, sf_dir), "session_id", "t")
    gold, pred = _edge_rows(_units(spark, sf_dir), bounds), _edge_rows(_pred(spark, sf_dir), bounds)
    return S.matched_boundaries(gold, pred, bounds, ["session_id"], tolerances, large=large_sessions(spark, sf_dir))


@query(f"{_SCORED} SELECT *, {_PRF} FROM sc")
def boundary_prf(spark, sf_dir):
    """Precision, recall and F1 of boundaries in every session, sessions without any on either side included."""
    return _scores(spark, sf_dir).withColumns(S.prf(F.col("tp"), F.col("n_gold"), F.col("n_pred")))


@query(f"{_SCORED}, t AS (SELECT tol, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_pred) AS BIGINT) AS n_pred FROM sc GROUP BY 1) SELECT *, {_PRF} FROM t")
def boundary_totals(spark, sf_dir):
    """The same over all sessions; boundaries are matched within a session only."""
    t = _scores(spark, sf_dir).groupBy("tol").agg(*[F.sum(c).alias(c) for c in ("tp", "n_gold", "n_pred")])
    return t.withColumns(S.prf(F.col("tp"), F.col("n_gold"), F.col("n_pred")))


def _marks(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "quality")


_T = "t AS (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)"


@query(f"WITH {_T} SELECT lang, quality, n, CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) AS na, CAST(sum(n) OVER (PARTITION BY quality) AS BIGINT) AS nb, (SELECT CAST(sum(n) AS BIGINT) FROM t) AS total FROM t")
def contingency(spark, sf_dir):
    return S.contingency(_marks(spark, sf_dir), "lang", "quality")


@query(f"""WITH {_T}, z AS (SELECT sum(n) AS tot FROM t), r AS (SELECT lang, sum(n) AS na FROM t GROUP BY 1), c AS (SELECT quality, sum(n) AS nb FROM t GROUP BY 1),
q AS (SELECT (SELECT -sum(na / tot * ln(na / tot)) FROM r, z) AS ha, (SELECT -sum(nb / tot * ln(nb / tot)) FROM c, z) AS hb,
 (SELECT -sum(n / tot * ln(n / nb)) FROM t JOIN c USING (quality), z) AS hab, (SELECT -sum(n / tot * ln(n / na)) FROM t JOIN r USING (lang), z) AS hba,
 (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(na * (na - 1) / 2) FROM r) AS sa, (SELECT sum(nb * (nb - 1) / 2) FROM c) AS sb, (SELECT tot * (tot - 1) / 2 FROM z) AS tt),
v AS (SELECT *, CASE WHEN ha = 0 THEN 1.0 ELSE 1 - hab / ha END AS h, CASE WHEN hb = 0 THEN 1.0 ELSE 1 - hba / hb END AS c FROM q)
SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(CASE WHEN h + c = 0 THEN 0 ELSE 2 * h * c / (h + c) END, 6) AS v_measure,
round((s - sa * sb / tt) / ((sa + sb) / 2 - sa * sb / tt), 6) AS adjusted_rand FROM v""")
def v_measure(spark, sf_dir):
    return S.agreement(S.contingency(_marks(spark, sf_dir), "lang", "quality"), "lang", "quality")


@query("""WITH t AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'R') AS x, count(*) FILTER (l_returnflag <> 'R') AS y FROM lineitem GROUP BY 1),
c AS (SELECT sum(x) OVER (ORDER BY v) AS x, sum(y) OVER (ORDER BY v) AS y FROM t) SELECT round(max(abs(x / (SELECT max(x) FROM c) - y / (SELECT max(y) FROM c))), 6) AS ks FROM c""")
def ks_two_sample(spark, sf_dir):
    return S.ks_statistic(table(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_returnflag") == "R")


@query("""WITH o AS (SELECT o_orderpriority AS label, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT label, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, quantile_cont(cents, 0.5) AS median, quantile_cont(cents, 0.75) - quantile_cont(cents, 0.25) AS iqr,
round_even(stddev_samp(cents) / avg(cents), 2) AS cv, round(100.0 * sum(cents) / sum(sum(cents)) OVER (), 4) AS share_pct FROM o GROUP BY 1""")
def process_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return R.profile(o, "label", "cents")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'board' WHEN o_totalprice >= 50000 THEN 'director' WHEN o_totalprice < 50000 THEN 'team' END AS outcome FROM orders")
def threshold_route(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", R.route(F.col("o_totalprice"), RULES).alias("outcome"))


@query(f"""WITH {_A}, v AS (SELECT k, event_type, count(*) AS votes FROM a WHERE k IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)
SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY votes DESC, event_type) = 1 AND votes >= 5""")
def term_majority(spark, sf_dir):
    return R.majority(activity(spark, sf_dir), "k", "event_type", 5)


@query("""WITH v AS (SELECT l_orderkey, l_linestatus, count(*) AS votes FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linestatus, votes FROM v QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1 AND votes >= 2""")
def unanimous_map(spark, sf_dir):
    return R.majority(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", 2, unanimous=True)


_TEXT = "concat('Invoice INV-', CAST(year(l_shipdate) AS VARCHAR), '-', CAST(l_orderkey AS VARCHAR), ' for PO-', CAST(1000 + l_suppkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '.')"


@query(rf"""WITH t AS (SELECT l_orderkey, l_linenumber, unnest(regexp_extract_all({_TEXT}, '\b[A-Z]{{1,6}}\d*-\d{{2,10}}-\d{{1,6}}\b')) AS case_id FROM lineitem)
SELECT l_orderkey, l_linenumber, case_id, split_part(case_id, '-', 1) AS prefix FROM t""")
def text_ids(spark, sf_dir):
    text = F.concat(F.lit("Invoice INV-"), F.year("l_shipdate").cast("string"), F.lit("-"), F.col("l_orderkey").cast("string"), F.lit(" for PO-"), (F.col("l_suppkey") + 1000).cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("."))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(case_ids(text)).alias("case_id"))
    return t.withColumn("prefix", case_prefix(F.col("case_id")))


@query(f"""WITH {_A} SELECT session_id, event_id, least(coalesce(lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id), max(t) OVER (PARTITION BY session_id)), t + {MAX_UNIT}) AS end_t FROM a WHERE event_type = 'view'""")
def inferred_end(spark, sf_dir):
    v = activity(spark, sf_dir).where("event_type = 'view'")
    w = Window.partitionBy("session_id")
    end = F.least(F.coalesce(F.lead("t").over(w.orderBy("t", "event_id")), F.max("t").over(w)), F.col("t") + MAX_UNIT)
    return v.select("session_id", "event_id", end.alias("end_t"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def crosstab(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def screen_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query(f"""WITH {_A} SELECT session_id, event_id, count(*) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND {6 * HOUR} FOLLOWING) AS near,
count(*) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN {24 * HOUR} PRECEDING AND {24 * HOUR} FOLLOWING) AS wide, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS gap FROM a""")
def density_features(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("t")
    near = lambda h: F.count("*").over(w.rangeBetween(-h * HOUR, h * HOUR))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("session_id").orderBy("t", "event_id"))
    return activity(spark, sf_dir).select("session_id", "event_id", near(6).alias("near"), near(24).alias("wide"), gap.alias("gap"))


@query("""WITH p AS (SELECT o_orderpriority AS label, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY 1)
SELECT * FROM (SELECT 'n' AS weighting, label, row_number() OVER (ORDER BY n DESC, label) AS place FROM p UNION ALL SELECT 'total', label, row_number() OVER (ORDER BY total DESC, label) FROM p) WHERE place <= 3""")
def robustness_top3(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("total"))
    long = p.unpivot(["label"], ["n", "total"], "weighting", "score")
    place = F.row_number().over(Window.partitionBy("weighting").orderBy(F.desc("score"), "label"))
    return long.select("weighting", "label", place.cast("bigint").alias("place")).where("place <= 3")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    w = F.window("ts", "1 day").alias("w")
    return table(spark, sf_dir, "events").groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query("SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'too long' WHEN regexp_matches(text, '^\\s*[\\[{]') THEN 'json' WHEN regexp_matches(text, '[A-Z]{1,6}-\\d{2,10}-\\d{1,6}') THEN 'identifier' END AS reason FROM documents")
def payload_guard(spark, sf_dir):
    t = F.col("text")
    reason = F.when(F.length(t) > 20_000, "too long").when(t.rlike(r"^\s*[\[{]"), "json").when(t.rlike(r"[A-Z]{1,6}-\d{2,10}-\d{1,6}"), "identifier")
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"))


def queries():
    from . import edge_reports, log_reports, reports, score_reports, unit_reports, worklist_reports  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql():
    from . import edge_reports, log_reports, reports, score_reports, unit_reports, worklist_reports  # noqa: F401

    return dict(_SQL)
