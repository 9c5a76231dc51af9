"""More registered queries: grids, timelines, window scores, audits, worklists and set tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _A, _GROUPS, HOUR, SNAP, _edge_rows, _EDGES, _pred, _units, _units_sql, query
from .functions.text import case_ids
from .operators import audits as U
from .operators import brackets as B
from .operators import grid as G
from .operators import rules as R
from .operators import suppress as X
from .sources.event_log import activity, keep, table
from .streaming import counts as C

_BD = "bd AS (SELECT session_id, min(t) AS t0, max(t) AS t1 FROM a GROUP BY 1)"
_N = f"greatest(1, CAST(ceil((t1 - t0) / {HOUR}) AS BIGINT))"


def _bounds(spark, sf_dir):
    return B.bounds(activity(spark, sf_dir), "session_id", "t")


def _targets(spark, sf_dir, kind):
    return activity(spark, sf_dir).where(F.col("event_type") == kind).select("session_id", F.col("t").alias("at"), F.col("k").alias("value"))


def _asof_sql(rows: str, t: str, kind: str, name: str) -> str:
    """Nearest event of a kind to each row, by two lateral lookups."""
    return f"""{name} AS (SELECT r.*, (SELECT max(t) FROM a WHERE a.session_id = r.session_id AND event_type = '{kind}' AND a.t <= r.{t}) AS {name}_b,
  (SELECT min(t) FROM a WHERE a.session_id = r.session_id AND event_type = '{kind}' AND a.t >= r.{t}) AS {name}_a FROM {rows} r),
{name}n AS (SELECT *, CASE WHEN {name}_b IS NULL THEN {name}_a WHEN {name}_a IS NULL THEN {name}_b WHEN {t} - {name}_b <= {name}_a - {t} THEN {name}_b ELSE {name}_a END AS {name}_t FROM {name})"""


_GRID = f"""WITH {_A}, {_BD}, gr AS (SELECT session_id, unnest(generate_series(t0, t0 + CAST(ceil((t1 - t0) / {HOUR}) AS BIGINT) * {HOUR}, {HOUR})) AS g FROM bd),
{_asof_sql('gr', 'g', 'click', 'c')}, lab AS (SELECT x.session_id, g, CASE WHEN abs(c_t - g) <= {24 * HOUR} THEN k END AS label FROM cn x LEFT JOIN a ON a.session_id = x.session_id AND a.t = c_t AND a.event_type = 'click')"""


@query(_GRID + " SELECT * FROM lab")
def grid_nearest_assignment(spark, sf_dir):
    points = G.asof(G.grid(_bounds(spark, sf_dir), "session_id", HOUR), "session_id", "g", _targets(spark, sf_dir, "click"), "at", "value")
    return points.select("session_id", "g", G.nearer(F.col("g"), 24 * HOUR)["value"].alias("label"))


@query(_GRID + f""", f AS (SELECT *, row_number() OVER w = 1 OR label IS DISTINCT FROM lag(label) OVER w AS first, max(g) OVER (PARTITION BY session_id) AS last FROM lab WINDOW w AS (PARTITION BY session_id ORDER BY g)),
u AS (SELECT session_id, label, g AS s, coalesce(lead(g) OVER (PARTITION BY session_id ORDER BY g), last) AS e FROM f WHERE first), v AS (SELECT * FROM u WHERE label IS NOT NULL),
{_asof_sql('v', 's', 'signup', 'p')}, {_asof_sql('pn', 'e', 'signup', 'q')},
z AS (SELECT session_id, label, CASE WHEN abs(p_t - s) <= {SNAP} THEN p_t ELSE s END AS start_ts, CASE WHEN abs(q_t - e) <= {SNAP} THEN q_t ELSE e END AS end_ts FROM qn)
SELECT session_id, start_ts, end_ts, label FROM z WHERE end_ts > start_ts""")
def grid_units(spark, sf_dir):
    return G.grid_units(_bounds(spark, sf_dir), _targets(spark, sf_dir, "click"), _targets(spark, sf_dir, "signup"), "session_id", HOUR, 24 * HOUR, SNAP)


_LINE = f"""WITH {_A}, {_BD}, {_GROUPS}, x AS (SELECT session_id, start_ts, end_ts, unnest(generate_series(greatest(0, CAST(floor((start_ts - t0) / {HOUR}) AS BIGINT)), least({_N}, CAST(ceil((end_ts - t0) / {HOUR}) AS BIGINT)) - 1)) AS bin
FROM pred JOIN bd USING (session_id)), line AS (SELECT session_id, bin, start_ts AS label FROM x QUALIFY row_number() OVER (PARTITION BY session_id, bin ORDER BY start_ts DESC, end_ts DESC) = 1)"""


def _line(spark, sf_dir):
    return G.timeline(_pred(spark, sf_dir).withColumn("label", F.col("start_ts")), _bounds(spark, sf_dir), "session_id", "label", HOUR)


@query(_LINE + " SELECT * FROM line")
def timeline_render(spark, sf_dir):
    return _line(spark, sf_dir)


@query(_LINE + f" SELECT session_id, round(1 - count(bin) / {_N}, 6) AS idle FROM bd LEFT JOIN line USING (session_id) GROUP BY session_id, t0, t1")
def idle_share(spark, sf_dir):
    n = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / HOUR))
    covered = _line(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("c"))
    return _bounds(spark, sf_dir).join(covered, "session_id", "left").select("session_id", F.round(1 - F.coalesce("c", F.lit(0)) / n, 6).alias("idle"))


@query(f"""WITH {_units_sql()}, {_GROUPS}, {_BD}, g AS ({_EDGES.format('units')}), p AS ({_EDGES.format('pred')}),
s AS (SELECT session_id, {_N} AS n, (SELECT count(*) FROM g WHERE g.session_id = bd.session_id) AS ng, (SELECT count(*) FROM p WHERE p.session_id = bd.session_id) AS np FROM bd),
k AS (SELECT *, greatest(2, CAST(round_even(n / (2 * greatest(1, ng)), 0) AS BIGINT)) AS k FROM s),
i AS (SELECT session_id, n, k, unnest(generate_series(0, n - k)) AS i FROM k WHERE n > k),
wd AS (SELECT *, (SELECT count(*) FROM g WHERE g.session_id = i.session_id AND bin >= i AND bin < i + k) <> (SELECT count(*) FROM p WHERE p.session_id = i.session_id AND bin >= i AND bin < i + k) AS bad FROM i)
SELECT session_id, n, k, round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END), 6) AS window_diff FROM wd GROUP BY 1, 2, 3 UNION ALL
SELECT session_id, n, k, CASE WHEN ng <> np THEN 1.0 ELSE 0.0 END FROM k WHERE n <= k""")
def windowdiff(spark, sf_dir):
    """Edges and bounds are made once; what follows reads these."""
    bounds = keep(_bounds(spark, sf_dir), "bounds")
    side = lambda units, d: _edge_rows(units, bounds).withColumn("side", F.lit(d))
    edges = keep(side(_units(spark, sf_dir), 1).unionByName(side(_pred(spark, sf_dir), 2)), "edges")
    one = lambda d: edges.where(F.col("side") == d).drop("side")
    return G.window_diff(one(1), one(2), bounds, "session_id", HOUR)


@query("""WITH d AS (SELECT doc_id, quality, lang = 'en' AS g FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL), c AS (SELECT count(*) FILTER (g) AS n, count(*) AS m FROM d),
r AS (SELECT draw, quality, CASE WHEN draw = 0 THEN g ELSE CAST(concat('0x', substr(md5(concat(draw, '-', doc_id)), 1, 7)) AS BIGINT) * m < n * 268435456 END AS inside FROM d, c, range(0, 201) t(draw)),
s AS (SELECT draw, avg(quality) FILTER (inside) - avg(quality) FILTER (NOT inside) AS stat FROM r GROUP BY 1), o AS (SELECT stat AS seen FROM s WHERE draw = 0)
SELECT round(max(seen), 6) AS observed, count(*) FILTER (draw > 0 AND abs(stat) >= abs(seen) - 1e-12) AS hits, round((count(*) FILTER (draw > 0 AND abs(stat) >= abs(seen) - 1e-12) + 1) / 201, 6) AS p FROM s, o""")
def randomisation_test(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "lang")
    return U.randomisation_test(d, "doc_id", "quality", F.col("lang") == "en", 200)


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, source AS top, CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) AS total, round(n / sum(n) OVER (PARTITION BY lang), 6) AS purity
FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1""")
def purity(spark, sf_dir):
    return U.purity(table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source").drop("votes", "share")


@query("""SELECT o_orderpriority AS mode, count(*) AS n, list_sort(list(CAST(round(o_totalprice * 100) AS BIGINT)))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50,
list_sort(list(CAST(round(o_totalprice * 100) AS BIGINT)))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95 FROM orders GROUP BY 1""")
def run_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mode"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return U.indexed_quantiles(o, "mode", "cents", {"p50": 0.5, "p95": 0.95})


@query(r"""WITH t AS (SELECT l_orderkey, string_agg(concat('INV-', CAST(10 + l_suppkey % 3 AS VARCHAR), '-', CAST(l_linenumber % 2 AS VARCHAR)), ' ' ORDER BY l_linenumber, l_suppkey % 3) AS txt FROM lineitem GROUP BY 1),
i AS (SELECT l_orderkey, length(txt) AS len, unnest(regexp_extract_all(txt, '\b[A-Z]{1,6}\d*-\d{2,10}-\d{1,6}\b')) AS case_id, generate_subscripts(regexp_extract_all(txt, '\b[A-Z]{1,6}\d*-\d{2,10}-\d{1,6}\b'), 1) AS pos FROM t),
c AS (SELECT l_orderkey, len, case_id, count(*) AS n, min(pos) AS pos FROM i GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, pos) AS r, count(*) OVER (PARTITION BY l_orderkey) AS k FROM c)
SELECT l_orderkey, case_id, CASE WHEN n >= 3 THEN 'dominance' ELSE 'uniqueness' END AS source FROM r WHERE r = 1 AND (n >= 3 OR (k = 1 AND len <= 400))""")
def dominant_id(spark, sf_dir):
    ident = F.concat(F.lit("INV-"), (F.col("l_suppkey") % 3 + 10).cast("string"), F.lit("-"), (F.col("l_linenumber") % 2).cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 3).alias("s"), ident.alias("id"))))
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(lines, lambda x: x["id"]), " ").alias("txt"))
    return U.dominant_ids(t, "l_orderkey", case_ids(F.col("txt")), F.length("txt"), 3, 400)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus <> 'O' THEN 'failed' WHEN o_totalprice >= 200000 THEN 'queued_for_review' WHEN o_totalprice >= 50000 THEN 'automated_by_rule' ELSE 'automated' END AS outcome FROM orders""")
def definition_match(spark, sf_dir):
    """Worklist rows by state and by the threshold table; an unknown state fails."""
    rules = [(0, ">=", "automated"), (50_000, ">=", "automated_by_rule"), (200_000, ">=", "queued_for_review")]
    outcome = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") != "O", "failed").otherwise(R.route(F.col("o_totalprice"), rules))
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"))


@query("""SELECT o_orderpriority AS screen, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS pending, coalesce(string_agg(DISTINCT CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_orderstatus END, ','), '') AS unknown FROM orders GROUP BY 1""")
def drift_check(spark, sf_dir):
    states = F.array_except(F.collect_set("o_orderstatus"), F.array(F.lit("O"), F.lit("F")))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("screen"))
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.array_join(F.array_sort(states), ",").alias("unknown"))


@query("""WITH p AS (SELECT o_orderpriority AS label, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') / count(*) AS manual, count(*) FILTER (o_totalprice >= 200000) / count(*) AS judged FROM orders GROUP BY 1)
SELECT label, round(n * manual * greatest(0.05, 1 - judged), 6) AS priority FROM p WHERE n >= 5""")
def rank_priority(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(
        F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "O").cast("int")).alias("manual"), F.avg((F.col("o_totalprice") >= 200_000).cast("int")).alias("judged")
    )
    return p.where("n >= 5").select("label", F.round(F.col("n") * F.col("manual") * F.greatest(F.lit(0.05), 1 - F.col("judged")), 6).alias("priority"))


_HEAD = r"split_part(split_part(url, '://', 2), '/', 1)"


@query(f"""SELECT {_HEAD} AS host, count(*) AS n, count(DISTINCT regexp_extract(url, '^[^:]+://[^/]+/([^/?#]*)', 1)) AS n_routes FROM pages WHERE url IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def system_discovery(spark, sf_dir):
    """Hosts with support, and how many first path segments each has."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    p = table(spark, sf_dir, "pages").where("url is not null").select(host.alias("host"), F.regexp_extract("url", "^[^:]+://[^/]+/([^/?#]*)", 1).alias("route"))
    return p.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("route").alias("n_routes")).where("n >= 2")


@query(f"""WITH {_A} SELECT k AS route, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS closes FROM a WHERE k IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (event_type = 'purchase') < 0.15 * count(*)""")
def non_routes(spark, sf_dir):
    """Routes that hardly ever end a unit."""
    n = activity(spark, sf_dir).where("k is not null").groupBy(F.col("k").alias("route"))
    return n.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("closes")).where("closes < 0.15 * n")


@query(f"""WITH {_A}, s AS (SELECT session_id, event_id, t, k, lag(t) OVER w AS pt, min(t) OVER (PARTITION BY session_id, k) AS first_t FROM a WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))
SELECT session_id, event_id, t = first_t AS is_new, t - pt AS since FROM s""")
def first_appearance(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    new = F.col("t") == F.min("t").over(Window.partitionBy("session_id", "k"))
    return activity(spark, sf_dir).select("session_id", "event_id", new.alias("is_new"), (F.col("t") - F.lag("t").over(w)).alias("since"))


@query(f"""WITH {_A}, h AS (SELECT session_id, t // {24 * HOUR} AS day, list_distinct(list(k)) AS ids FROM a GROUP BY 1, 2), p AS (SELECT *, coalesce(lag(ids) OVER (PARTITION BY session_id ORDER BY day), []) AS before FROM h)
SELECT session_id, CAST(day AS BIGINT) AS day, CAST(len(ids) AS INTEGER) AS n_ids, CAST(len(list_filter(ids, lambda x: NOT list_contains(before, x))) AS INTEGER) AS n_new FROM p""")
def capture_new_ids(spark, sf_dir):
    day = F.expr(f"t div {24 * HOUR}")
    h = activity(spark, sf_dir).groupBy("session_id", day.alias("day")).agg(F.collect_set("k").alias("ids"))
    before = F.coalesce(F.lag("ids").over(Window.partitionBy("session_id").orderBy("day")), F.expr("cast(array() as array<int>)"))
    return h.select("session_id", "day", F.size("ids").alias("n_ids"), F.size(F.array_except("ids", before)).alias("n_new"))


@query(f"""WITH {_units_sql()}, n AS (SELECT *, lead(start_ts) OVER (PARTITION BY session_id ORDER BY start_ts, end_ts) - end_ts AS gap FROM units)
SELECT session_id, count(*) AS n_units, count(*) FILTER (gap < 0) AS overlaps, count(*) FILTER (gap = 0) AS touching, min(gap) AS least_gap FROM n GROUP BY 1""")
def unit_gaps(spark, sf_dir):
    gap = F.lead("start_ts").over(Window.partitionBy("session_id").orderBy("start_ts", "end_ts")) - F.col("end_ts")
    n = _units(spark, sf_dir).withColumn("gap", gap)
    return n.groupBy("session_id").agg(F.count("*").alias("n_units"), F.count_if(F.expr("gap < 0")).alias("overlaps"), F.count_if(F.expr("gap = 0")).alias("touching"), F.min("gap").alias("least_gap"))


@query(f"""WITH {_units_sql()}, {_BD} SELECT session_id, round(coalesce(sum(end_ts - start_ts), 0) / (t1 - t0), 6) AS coverage FROM bd LEFT JOIN units USING (session_id) WHERE t1 > t0 GROUP BY session_id, t0, t1""")
def coverage(spark, sf_dir):
    spent = _units(spark, sf_dir).groupBy("session_id").agg(F.sum(F.col("end_ts") - F.col("start_ts")).alias("d"))
    b = _bounds(spark, sf_dir).where("t1 > t0").join(spent, "session_id", "left")
    return b.select("session_id", F.round(F.coalesce("d", F.lit(0)) / (F.col("t1") - F.col("t0")), 6).alias("coverage"))


@query(f"""WITH {_A} SELECT p.session_id, p.event_id, count(q.event_id) AS near FROM a p LEFT JOIN a q ON q.session_id = p.session_id AND q.event_type = 'click' AND q.t BETWEEN p.t - {2 * HOUR} AND p.t + {2 * HOUR} WHERE p.event_type = 'purchase' GROUP BY 1, 2""")
def band_signal_hits(spark, sf_dir):
    """Clicks within two hours of each purchase, by a range window instead of a join."""
    w = Window.partitionBy("session_id").orderBy("t").rangeBetween(-2 * HOUR, 2 * HOUR)
    a = activity(spark, sf_dir).withColumn("near", F.count_if(F.col("event_type") == "click").over(w))
    return a.where("event_type = 'purchase'").select("session_id", "event_id", "near")


@query(f"""WITH {_A}, v AS (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS nx, max(t) OVER (PARTITION BY session_id) AS t1 FROM a WHERE event_type = 'view')
SELECT session_id, t AS start_ts, greatest(coalesce(nx, t1), t + 1000000) AS end_ts FROM v""")
def open_to_open(spark, sf_dir):
    w = Window.partitionBy("session_id")
    v = activity(spark, sf_dir).where("event_type = 'view'")
    end = F.coalesce(F.lead("t").over(w.orderBy("t", "event_id")), F.max("t").over(w))
    return v.select("session_id", F.col("t").alias("start_ts"), F.greatest(end, F.col("t") + 1_000_000).alias("end_ts"))


_SWEEP = " UNION ALL ".join(
    f"SELECT {h} AS gap_hours, count(*) AS groups FROM (SELECT t - lag(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS d FROM a WHERE event_type <> 'error') WHERE d IS NULL OR d > {h * HOUR}" for h in (3, 6, 12, 24)
)


@query(f"WITH {_A} {_SWEEP}")
def gap_sweep(spark, sf_dir):
    """Number of sessions at several gaps, in one pass over the differences."""
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    d = activity(spark, sf_dir).where("event_type <> 'error'").select((F.col("t") - F.lag("t").over(w)).alias("d"))
    hours = F.explode(F.array(*[F.lit(h) for h in (3, 6, 12, 24)]))
    return d.withColumn("gap_hours", hours).groupBy("gap_hours").agg(F.count_if(F.col("d").isNull() | (F.col("d") > F.col("gap_hours").cast("bigint") * HOUR)).alias("groups"))


@query("SELECT least(CAST(round(l_discount * 1000) AS BIGINT) // 10, 9) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram10(spark, sf_dir):
    """Ten bins over [0, 0.1], counted in thousandths; the last one is closed on the right."""
    b = F.least(F.floor(F.round(F.col("l_discount") * 1000) / 10), F.lit(9))
    return table(spark, sf_dir, "lineitem").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT c AS column_name, term, count(*) AS n FROM (SELECT 'lang' AS c, lang AS v FROM documents UNION ALL SELECT 'source', source FROM documents), (VALUES ('en'), ('web'), ('de')) t(term) WHERE contains(v, term) GROUP BY 1, 2""")
def unpivot_terms(spark, sf_dir):
    long = table(spark, sf_dir, "documents").select("lang", "source").unpivot([], ["lang", "source"], "column_name", "v")
    terms = F.explode(F.array(*[F.lit(t) for t in ("en", "web", "de")]))
    return long.withColumn("term", terms).where(F.col("v").contains(F.col("term"))).groupBy("column_name", "term").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS listed FROM orders GROUP BY 1")
def distinct_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority")
    return o.agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("states"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("listed"))


@query(f"""WITH {_units_sql()}, {_GROUPS}, c AS (SELECT 'ordered' AS name, count(*) FILTER (end_ts <= start_ts) AS bad FROM units UNION ALL
SELECT 'no overlap', count(*) FILTER (nx < end_ts) FROM (SELECT *, lead(start_ts) OVER (PARTITION BY session_id ORDER BY start_ts, end_ts) AS nx FROM units) UNION ALL
SELECT 'known session', count(*) FROM units WHERE session_id NOT IN (SELECT session_id FROM a)) SELECT name, bad, bad = 0 AS ok FROM c""")
def self_checks(spark, sf_dir):
    """Invariants of the units as rows of (name, bad, ok)."""
    units = _units(spark, sf_dir)
    nx = F.lead("start_ts").over(Window.partitionBy("session_id").orderBy("start_ts", "end_ts"))
    u = units.withColumn("nx", nx).agg(F.count_if(F.expr("end_ts <= start_ts")).alias("ordered"), F.count_if(F.expr("nx < end_ts")).alias("no overlap"))
    lost = units.join(activity(spark, sf_dir), "session_id", "left_anti").agg(F.count("*").alias("known session"))
    c = u.crossJoin(lost).unpivot([], ["ordered", "no overlap", "known session"], "name", "bad")  # one row each
    return c.withColumn("ok", F.col("bad") == 0)


@query(f"""WITH {_A}, l AS (SELECT *, lead(event_type) OVER (PARTITION BY session_id ORDER BY t, event_id) AS nx FROM a), r AS (SELECT k AS tag, count(*) AS n, count(*) FILTER (nx = 'purchase') AS hits FROM l GROUP BY 1)
SELECT tag, n, hits, round(hits / n * sqrt(hits), 6) AS score FROM r WHERE n >= 20""")
def tag_rule_discovery(spark, sf_dir):
    nx = F.lead("event_type").over(Window.partitionBy("session_id").orderBy("t", "event_id"))
    r = activity(spark, sf_dir).withColumn("nx", nx).groupBy(F.col("k").alias("tag")).agg(F.count("*").alias("n"), F.count_if(F.col("nx") == "purchase").alias("hits"))
    return r.where("n >= 20").withColumn("score", F.round(F.col("hits") / F.col("n") * F.sqrt("hits"), 6))


@query("SELECT date_trunc('hour', ts) - to_hours(12 * s) - to_hours(CAST(hour(ts) % 12 AS BIGINT)) AS start_ts, event_type, count(*) AS n FROM events, range(0, 2) r(s) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    """Windows of a day that begin every twelve hours, by the streaming operator on a batch table."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return C.window_counts(e, "24 hours", "12 hours").withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz"))


@query("SELECT o_orderkey % 100 < 51 AS dev, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def dev_test_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 100 < 51).alias("dev")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query()
def non_max_suppression(spark, sf_dir):
    """Clicks by falling value, three hours apart at least; SQL has no such fold, a test compares it with a loop."""
    clicks = activity(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id").where("event_type = 'click'")
    return X.non_max(clicks, "session_id", "t", "value", 3 * HOUR)
