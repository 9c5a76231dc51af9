"""Registered queries on the edges and contents of units: features, boundaries, precision of anchors, profiles, unions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _GROUPS, _WIDE, CAP, HOUR, MAX_UNIT, MIN_UNIT, _A, _edge_rows, _pred, _units, _units_sql, large_sessions, query
from . import desk
from .desk import LOG_SQL, log
from .functions.text import case_ids
from .log_reports import _ANCHORS, _DOCS, _L, _LABELS, _LU, _MS, _STATES, _SYSTEMS, DAY_MS, ID, anchors, documents_of, labelled, systems, units_ms
from .operators import audits as U
from .operators import brackets as B
from .operators import intervals as I
from .operators import learn as M
from .operators import scoring as P
from .operators.grid import asof
from .operators.suppress import non_max
from .sources import event_log as S
from .sources.event_log import activity, keep, table
from .unit_reports import bracket_tail

SECOND = 1_000_000


@query(f"""WITH {_A}, {_GROUPS}, bd AS (SELECT session_id, min(t) AS t0, max(t) AS t1 FROM a GROUP BY 1),
e AS (SELECT session_id, start_ts, least(CASE WHEN end_ts = start_ts THEN end_ts + {SECOND} ELSE end_ts END, t1) AS end_ts FROM pred JOIN bd USING (session_id)) SELECT * FROM e WHERE end_ts > start_ts""")
def segment_emit(spark, sf_dir):
    """Groups as segments: of one second at least, clipped to the session, dropped if nothing is left."""
    end = F.when(F.col("end_ts") == F.col("start_ts"), F.col("end_ts") + SECOND).otherwise(F.col("end_ts"))
    g = _pred(spark, sf_dir).join(B.bounds(activity(spark, sf_dir), "session_id", "t"), "session_id")
    return g.select("session_id", "start_ts", F.least(end, F.col("t1")).alias("end_ts")).where("end_ts > start_ts")


@query(f"""{_L}, o AS (SELECT *, ts_ms - coalesce(lag(ts_ms) OVER w, ts_ms) AS gp, coalesce(lead(ts_ms) OVER w, ts_ms) - ts_ms AS gn, min(ts_ms) OVER (PARTITION BY session_id) AS t0, max(ts_ms) OVER (PARTITION BY session_id) AS t1,
 row_number() OVER w = 1 AS head, lag(app) OVER w AS pa, lag(title) OVER w AS pt, lag(url) OVER w AS pu FROM l WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id))
SELECT session_id, event_id, round(ln(1 + gp), 6) AS log_before, round(ln(1 + gn), 6) AS log_after, round(ln(1 + gn) - ln(1 + gp), 6) AS log_change, round((ts_ms - t0) / greatest(t1 - t0, 1), 6) AS position,
{', '.join(f"count(*) OVER (PARTITION BY session_id ORDER BY ts_ms RANGE BETWEEN {h * 3600000} PRECEDING AND 1 PRECEDING) AS before_{h}, count(*) OVER (PARTITION BY session_id ORDER BY ts_ms RANGE BETWEEN 1 FOLLOWING AND {h * 3600000} FOLLOWING) AS after_{h}" for h in (5, 30))},
CAST(NOT head AND app IS DISTINCT FROM pa AS INTEGER) AS new_app, CAST(NOT head AND title IS DISTINCT FROM pt AS INTEGER) AS new_title, CAST(NOT head AND url IS DISTINCT FROM pu AS INTEGER) AS new_url, CAST(has_text AS INTEGER) AS has_text, CAST(url IS NOT NULL AS INTEGER) AS has_url,
CASE layer WHEN 'L3' THEN 3 WHEN 'L2' THEN 2 ELSE 0 END AS layer FROM o""")
def event_features(spark, sf_dir):
    """What a tagger sees of an event: log gaps, place in the session, neighbours within 5 and 30 hours, changes, flags."""
    w, t = Window.partitionBy("session_id").orderBy("ts_ms", "event_id"), Window.partitionBy("session_id").orderBy("ts_ms")
    s = Window.partitionBy("session_id")
    ts = F.col("ts_ms")
    d = log(spark, sf_dir).withColumns({"gp": ts - F.coalesce(F.lag(ts).over(w), ts), "gn": F.coalesce(F.lead(ts).over(w), ts) - ts, "t0": F.min(ts).over(s), "t1": F.max(ts).over(s), "head": F.row_number().over(w) == 1})
    changed = lambda c: (~F.col("head") & ~F.col(c).eqNullSafe(F.lag(c).over(w))).cast("int").alias(f"new_{c}")
    near = [F.count("*").over(t.rangeBetween(*r)).alias(n) for h in (5, 30) for n, r in ((f"before_{h}", (-h * 3_600_000, -1)), (f"after_{h}", (1, h * 3_600_000)))]
    return d.select(
        "session_id", "event_id", F.round(F.log1p("gp"), 6).alias("log_before"), F.round(F.log1p("gn"), 6).alias("log_after"), F.round(F.log1p("gn") - F.log1p("gp"), 6).alias("log_change"),
        F.round((ts - F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1)), 6).alias("position"), *near, changed("app"), changed("title"), changed("url"),
        F.col("has_text").cast("int").alias("has_text"), F.col("url").isNotNull().cast("int").alias("has_url"), F.when(F.col("layer") == "L3", 3).when(F.col("layer") == "L2", 2).otherwise(0).alias("layer"),
    )


_EDGE = f"""ed AS (SELECT session_id, start_ts AS t, 1 AS cls, start_ts AS u FROM units UNION ALL SELECT session_id, end_ts, 2, start_ts FROM units),
ec AS (SELECT session_id, u, cls, t, (SELECT max(q.t) FROM a q WHERE q.session_id = ed.session_id AND q.t < ed.t) AS b, (SELECT min(q.t) FROM a q WHERE q.session_id = ed.session_id AND q.t >= ed.t) AS n FROM ed),
ef AS (SELECT session_id, list(struct_pack(c := CASE WHEN t - b <= {5 * HOUR} THEN b END, d := CASE WHEN n - t <= {5 * HOUR} THEN n END, cls := cls) ORDER BY u, cls) AS e FROM ec GROUP BY 1)"""


@query(f"""WITH {_units_sql()}, {_EDGE}, fo AS (SELECT session_id, list_reduce(list_prepend([struct_pack(t := CAST(NULL AS BIGINT), cls := 0)], list_transform(e, lambda z: [struct_pack(t := z.c, cls := z.cls), struct_pack(t := z.d, cls := z.cls)])), lambda s, z:
 CASE WHEN z[1].t IS NOT NULL AND NOT list_contains(list_transform(s, lambda q: q.t), z[1].t) THEN list_append(s, z[1]) WHEN z[2].t IS NOT NULL AND NOT list_contains(list_transform(s, lambda q: q.t), z[2].t) THEN list_append(s, z[2]) ELSE s END) AS f FROM ef)
SELECT session_id, y.t AS t, y.cls AS cls FROM (SELECT session_id, unnest(f) AS y FROM fo) WHERE y.t IS NOT NULL""")
def edge_labels(spark, sf_dir):
    """The event that each edge of a unit labels (1 opens, 2 closes): the one before it, or the one from it on, within
    five hours, whichever no earlier edge took.  Edges come in order, so only the last places taken need a look."""
    u, a = _units(spark, sf_dir), activity(spark, sf_dir)
    edges = u.select("session_id", F.explode(F.array(F.struct(F.col("start_ts").alias("t"), F.lit(1).alias("cls")), F.struct(F.col("end_ts").alias("t"), F.lit(2).alias("cls")))).alias("x"), F.col("start_ts").alias("u"))
    edges = edges.select("session_id", "u", "x.*")
    targets = a.select("session_id", F.col("t").alias("at"), F.col("event_id").alias("value"))
    strictly = asof(edges.withColumn("_s", F.col("t") - 1), "session_id", "_s", targets, "at", "value").withColumn("b", F.col("before.at")).drop("before", "after", "_s")
    near = asof(strictly, "session_id", "t", targets, "at", "value")
    close = lambda c, d: F.when(d <= 5 * HOUR, c)
    item = F.struct("u", "cls", close(F.col("b"), F.col("t") - F.col("b")).alias("c"), close(F.col("after.at"), F.col("after.at") - F.col("t")).alias("d"))
    e = near.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    free = lambda s, t: t.isNotNull() & ~F.exists(F.slice(s, -8, 8), lambda q: q["t"].eqNullSafe(t))
    take = lambda s, t, cls: F.array_append(s, F.struct(t.alias("t"), cls.alias("cls")))
    start = F.expr("array(named_struct('t', cast(null as bigint), 'cls', 0))")
    pad = F.concat(F.array_repeat(F.expr("named_struct('t', cast(null as bigint), 'cls', 0)"), 8))
    folded = F.aggregate("e", F.concat(start, pad), lambda s, x: F.when(free(s, x["c"]), take(s, x["c"], x["cls"])).when(free(s, x["d"]), take(s, x["d"], x["cls"])).otherwise(s))
    return e.select("session_id", F.explode(folded).alias("y")).select("session_id", "y.t", "y.cls").where("t is not null")


@query(f"""{_L}, g AS (SELECT ds, ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS gap FROM tx), s AS (SELECT ds, count(*) AS n, list_sort(list(gap)) AS v FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT ds, n, v[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(n * 0.9) AS BIGINT) + 1] AS p90, v[n] AS longest FROM s""")
def capture_gaps(spark, sf_dir):
    """Time between captured texts: list-index quantiles, and the longest."""
    t = desk.texts(spark, sf_dir).join(log(spark, sf_dir).select("event_id", "ds"), "event_id")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("session_id").orderBy("ts_ms", "event_id"))
    g = t.withColumn("gap", gap).where("gap is not null")
    return U.indexed_quantiles(g, "ds", "gap", {"p50": 0.5, "p90": 0.9}).join(g.groupBy("ds").agg(F.max("gap").alias("longest")), "ds")


@query(rf"""{_L}, c AS (SELECT ds, len(list_distinct(regexp_extract_all(text, '\b{ID}\b'))) AS n, len(regexp_extract_all(text, '\b{ID}\b')) AS m FROM tx)
SELECT ds, count(*) AS captures, round(avg(n), 6) AS mean, quantile_cont(m, 0.5) AS p50, quantile_cont(m, 0.9) AS p90, CAST(max(m) AS INTEGER) AS most FROM c GROUP BY 1""")
def ids_per_capture(spark, sf_dir):
    """Distinct identifiers of a capture (mean), and all of them (quantiles)."""
    ids = case_ids(F.col("text"))
    c = desk.texts(spark, sf_dir).join(log(spark, sf_dir).select("event_id", "ds"), "event_id").select("ds", F.size(F.array_distinct(ids)).alias("n"), F.size(ids).alias("m"))
    return c.groupBy("ds").agg(F.count("*").alias("captures"), F.round(F.avg("n"), 6).alias("mean"), F.expr("percentile(m, 0.5)").alias("p50"), F.expr("percentile(m, 0.9)").alias("p90"), F.max("m").alias("most"))


_RUNS = f"""um AS (SELECT concat('ses_', u.session_id) AS session_id, u.start_ts // 1000 AS start_ts, u.end_ts // 1000 AS end_ts, concat('INV-', 10 + u.session_id % 5, '-', k) AS "case" FROM units u JOIN a ON a.session_id = u.session_id AND a.t = u.end_ts AND event_type = 'purchase'),
ex AS (SELECT session_id, "case", min(start_ts) AS start_ts, min_by(end_ts, start_ts) AS end_ts FROM um GROUP BY 1, 2)"""


def _runs(spark, sf_dir):
    """Executions by (session, case): the first unit that closes on each case."""
    a = activity(spark, sf_dir).where("event_type = 'purchase'").select("session_id", F.col("t").alias("end_ts"), "k")
    u = _units(spark, sf_dir).join(a, ["session_id", "end_ts"])
    ms = lambda c: F.expr(f"{c} div 1000").alias(c)
    case = F.concat(F.lit("INV-"), (10 + F.col("session_id") % 5).cast("string"), F.lit("-"), F.col("k").cast("string"))
    u = u.select(F.concat(F.lit("ses_"), F.col("session_id").cast("string")).alias("session_id"), ms("start_ts"), ms("end_ts"), case.alias("case"))
    first = F.min(F.struct("start_ts", "end_ts")).alias("x")
    return u.groupBy("session_id", "case").agg(first).select("session_id", "case", "x.*")


_RULES = {"count 1": (1, 1.0), "count 2": (2, 1.0), "count 3": (3, 1.0), "count 3, twice the next": (3, 2.0)}
_RULED = " UNION ALL ".join(f"SELECT '{k}' AS rule, session_id, \"case\", ts_ms FROM tt WHERE n >= {c} AND n >= {r} * greatest(coalesce(second, 1), 1)" for k, (c, r) in _RULES.items())


@query(rf"""WITH {LOG_SQL}, {_units_sql()}, {_RUNS}, ti AS (SELECT event_id, session_id, ts_ms, unnest(regexp_extract_all(text, '\b{ID}\b')) AS "case", generate_subscripts(regexp_extract_all(text, '\b{ID}\b'), 1) AS pos FROM tx),
tc AS (SELECT event_id, session_id, ts_ms, "case", count(*) AS n, min(pos) AS pos FROM ti GROUP BY ALL), tt AS (SELECT *, lead(n) OVER (PARTITION BY event_id ORDER BY n DESC, pos) AS second FROM tc QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, pos) = 1),
ob AS ({_RULED} UNION ALL SELECT 'click', session_id, "case", ts_ms FROM (WITH {_ANCHORS.split('an AS')[0].rstrip().rstrip(',')} SELECT * FROM al WHERE source = 'click')),
j AS (SELECT rule, ob.session_id, ob."case", ts_ms BETWEEN start_ts AND end_ts AS ok FROM ob JOIN ex ON ex.session_id = ob.session_id AND ex."case" = ob."case")
SELECT rule, count(*) AS n, count(*) FILTER (ok) AS hits, round(100.0 * count(*) FILTER (ok) / count(*), 4) AS precision, round(100.0 * count(DISTINCT CASE WHEN ok THEN session_id || '|' || "case" END) / (SELECT count(*) FROM ex), 4) AS coverage FROM j GROUP BY 1""")
def anchor_precision(spark, sf_dir):
    """Of each rule for anchors: how many fall into the execution of their case, and how many executions they find."""
    from .operators import labels as L

    t = desk.texts(spark, sf_dir).select("event_id", "session_id", "ts_ms", F.posexplode(case_ids(F.col("text"))).alias("pos", "case"))
    c = t.groupBy("event_id", "session_id", "ts_ms", "case").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy("event_id").orderBy(F.desc("n"), "pos")
    top = c.withColumn("second", F.lead("n").over(w)).withColumn("r", F.row_number().over(w)).where("r = 1")
    holds = [F.when((F.col("n") >= k) & (F.col("n") >= r * F.greatest(F.coalesce("second", F.lit(1)), F.lit(1))), F.lit(name)) for name, (k, r) in _RULES.items()]
    seen = top.select(F.explode(F.array_compact(F.array(*holds))).alias("rule"), "session_id", "case", "ts_ms")
    clicks = L.click_anchors(log(spark, sf_dir)).select(F.lit("click").alias("rule"), "session_id", "case", "ts_ms")
    runs = _runs(spark, sf_dir)
    j = seen.unionByName(clicks).join(runs, ["session_id", "case"]).withColumn("ok", F.col("ts_ms").between(F.col("start_ts"), F.col("end_ts")))
    out = j.groupBy("rule").agg(F.count("*").alias("n"), F.count_if("ok").alias("hits"), F.count_distinct(F.when(F.col("ok"), F.concat_ws("|", "session_id", "case"))).alias("found"))
    every = runs.agg(F.count("*").alias("every"))  # one row
    return out.crossJoin(F.broadcast(every)).select("rule", "n", "hits", F.round(100.0 * F.col("hits") / F.col("n"), 4).alias("precision"), F.round(100.0 * F.col("found") / F.col("every"), 4).alias("coverage"))


@query(f"""WITH {LOG_SQL}, {_units_sql()}, {_RUNS}, f AS (SELECT session_id, 'el_name' AS field, el_name AS v FROM l UNION ALL SELECT session_id, 'title', title FROM l UNION ALL SELECT session_id, 'url', url FROM l UNION ALL SELECT session_id, 'text', text FROM tx)
SELECT field, count(DISTINCT f.session_id || '|' || "case") AS found, round(count(DISTINCT f.session_id || '|' || "case") / (SELECT count(*) FROM ex), 6) AS recall FROM f JOIN ex ON ex.session_id = f.session_id AND contains(v, "case") GROUP BY 1""")
def field_recall(spark, sf_dir):
    """Of all executions' cases, those that each field of their session holds."""
    flat = log(spark, sf_dir).join(desk.texts(spark, sf_dir).select("event_id", "text"), "event_id", "left").select("session_id", "el_name", "title", "url", "text")
    long = flat.unpivot(["session_id"], ["el_name", "title", "url", "text"], "field", "v").where("v is not null").distinct()
    runs = _runs(spark, sf_dir)
    hits = long.join(runs.select("session_id", "case"), "session_id").where(F.contains("v", F.col("case"))).groupBy("field").agg(F.count_distinct("session_id", "case").alias("found"))
    return hits.crossJoin(F.broadcast(runs.agg(F.count("*").alias("every")))).select("field", "found", F.round(F.col("found") / F.col("every"), 6).alias("recall"))  # one row


_COLUMNS = ("event_type", "app", "title", "url")
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM l WHERE {c} IS NOT NULL" for c in _COLUMNS)


@query(f"{_L}, c AS (SELECT column_name, value, count(*) AS n FROM ({_LONG}) GROUP BY 1, 2) SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place FROM c QUALIFY place <= 5")
def frequency_tables(spark, sf_dir):
    """The five most frequent values of each column."""
    n = log(spark, sf_dir).select(*_COLUMNS).unpivot([], list(_COLUMNS), "column_name", "value").where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value")).cast("bigint")
    return n.withColumn("place", place).where("place <= 5")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_rows(spark, sf_dir):
    """The ten dearest parts: a top-k report, taken per task and merged."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query(f"""{_LU}, {_STATES}, {_LABELS}, ev AS (SELECT lb2.session_id, start_ts, end_ts, label, machine, event_type, app, ts_ms, l.event_id FROM lb2 LEFT JOIN l ON l.session_id = lb2.session_id AND ts_ms BETWEEN start_ts AND end_ts),
s AS (SELECT session_id, start_ts, end_ts, label, min_by(machine, (ts_ms, event_id)) AS machine, count(*) FILTER (event_type = 'app_switch') AS switches, count(*) FILTER (event_type = 'keystroke') AS keystrokes, count(DISTINCT app) AS apps, CAST(coalesce(max(CASE WHEN app = 'Writer' THEN 1 ELSE 0 END), 0) AS INTEGER) AS writer, end_ts - start_ts AS spent FROM ev GROUP BY session_id, start_ts, end_ts, label)
SELECT label, count(*) AS n, CAST(sum(spent) AS BIGINT) AS spent, quantile_cont(spent, 0.5) AS median, quantile_cont(spent, 0.75) - quantile_cont(spent, 0.25) AS iqr, quantile_cont(spent, 0.9) AS p90, count(DISTINCT machine) AS people, count(DISTINCT session_id) AS sessions, round(avg(switches), 6) AS switches, round(avg(keystrokes), 6) AS keystrokes,
round(avg(apps), 6) AS apps, round(100.0 * avg(writer), 4) AS writer_pct, round(100.0 * sum(spent) / sum(sum(spent)) OVER (), 4) AS share_pct, round_even(stddev_samp(spent) / avg(spent), 2) AS cv FROM s GROUP BY 1""")
def label_profile(spark, sf_dir):
    """The full profile of each label: runs, time, spread, people, sessions, means of what happens in a run, shares."""
    e = log(spark, sf_dir).select("session_id", "ts_ms", "event_id", "machine", "event_type", "app")
    inside = I.containment(labelled(spark, sf_dir), e, "session_id", "ts_ms", DAY_MS)
    s = inside.groupBy("session_id", "start_ts", "end_ts", "label").agg(
        F.min(F.when(F.col("event_id").isNotNull(), F.struct("ts_ms", "event_id", "machine"))).alias("m"), F.count_if(F.col("event_type") == "app_switch").alias("switches"), F.count_if(F.col("event_type") == "keystroke").alias("keystrokes"),
        F.count_distinct("app").alias("apps"), F.max(F.when(F.col("app") == "Writer", 1).otherwise(0)).alias("writer"),
    ).withColumn("spent", F.col("end_ts") - F.col("start_ts"))
    q = lambda x: F.expr(f"percentile(spent, {x})")
    p = s.groupBy("label").agg(
        F.count("*").alias("n"), F.sum("spent").alias("spent"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), q(0.9).alias("p90"), F.count_distinct("m.machine").alias("people"), F.count_distinct("session_id").alias("sessions"),
        *[F.round(F.avg(c), 6).alias(c) for c in ("switches", "keystrokes", "apps")], F.round(100.0 * F.avg("writer"), 4).alias("writer_pct"), F.bround(F.stddev_samp("spent") / F.avg("spent"), 2).alias("cv"),
    )
    return p.withColumn("share_pct", F.round(100.0 * F.col("spent") / F.sum("spent").over(Window.partitionBy()), 4))  # one row a label


@query(f"""{_L}, {_SYSTEMS}, d AS (SELECT session_id, count(DISTINCT head) AS systems FROM hd WHERE head <> '' GROUP BY 1) SELECT systems, count(*) AS sessions FROM d GROUP BY 1""")
def systems_per_session(spark, sf_dir):
    """How many sessions show how many window heads."""
    from .operators import labels as L

    head = L.title_head(F.col("title"))
    d = log(spark, sf_dir).where("title is not null").select("session_id", head.alias("head")).where("head <> ''")
    return d.groupBy("session_id").agg(F.count_distinct("head").alias("systems")).groupBy("systems").agg(F.count("*").alias("sessions"))


@query(f"""{_LU}, {_STATES}, {_LABELS}, c AS (SELECT lb2.*, 'P' || (end_ts % 3) AS code, substr(session_id, 5)::BIGINT % 2 = 0 AS dev FROM lb2), xc AS (SELECT label, list_distinct(list(code)) AS codes FROM c WHERE dev GROUP BY 1)
SELECT label, count(*) AS n, count(*) FILTER (list_contains(codes, code)) AS hits FROM c JOIN xc USING (label) WHERE NOT dev GROUP BY 1""")
def code_purity(spark, sf_dir):
    """Of units in one half of the sessions, those whose code is among the codes that their label has in the other half."""
    code, dev = F.concat(F.lit("P"), (F.col("end_ts") % 3).cast("string")), F.substring("session_id", 5, 20).cast("bigint") % 2 == 0
    c = labelled(spark, sf_dir).withColumns({"code": code, "dev": dev})
    x = c.where("dev").groupBy("label").agg(F.collect_set("code").alias("codes"))
    return c.where("not dev").join(x, "label").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.array_contains("codes", F.col("code"))).alias("hits"))


@query(f"""{_L}, r AS (SELECT event_id, session_id, chunk_id, 'f' || (gap_ms % 10) AS file FROM l WHERE has_text), f AS (SELECT DISTINCT session_id, chunk_id, 'f' || (gap_ms % 10) AS file FROM l WHERE event_type = 'mouse_click'), s AS (SELECT DISTINCT session_id, file FROM f)
SELECT CASE WHEN f.file IS NOT NULL THEN 'own' WHEN s.file IS NOT NULL THEN 'sibling' ELSE 'absent' END AS place, count(*) AS n FROM r LEFT JOIN f ON f.session_id = r.session_id AND f.chunk_id = r.chunk_id AND f.file = r.file LEFT JOIN s ON s.session_id = r.session_id AND s.file = r.file GROUP BY 1""")
def file_integrity(spark, sf_dir):
    """Where the files that events name lie: in their own folder, in another one of the session, or nowhere."""
    d = log(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), (F.col("gap_ms") % 10).cast("string")))
    own = d.where("event_type = 'mouse_click'").select("session_id", "chunk_id", "file", F.lit(True).alias("here")).distinct()
    session = own.select("session_id", "file", F.lit(True).alias("near")).distinct()
    r = d.where("has_text").join(own, ["session_id", "chunk_id", "file"], "left").join(session, ["session_id", "file"], "left")
    return r.groupBy(F.when(F.col("here"), "own").when(F.col("near"), "sibling").otherwise("absent").alias("place")).agg(F.count("*").alias("n"))


@query(f"{_WIDE}, g AS (SELECT lead(wide_start) OVER (PARTITION BY session_id ORDER BY wide_start, wide_end) - wide_end AS gap FROM wide) SELECT count(gap) AS gaps, quantile_cont(gap, 0.5) AS median, round(count(*) FILTER (gap = 0) / count(gap), 6) AS zero_share FROM g")
def gap_summary(spark, sf_dir):
    """Gaps between consecutive widened units: their median, and the share of none at all."""
    u = B.expand(_units(spark, sf_dir), B.bounds(activity(spark, sf_dir), "session_id", "t"), "session_id", CAP, large=large_sessions(spark, sf_dir))
    g = u.select((F.lead("wide_start").over(Window.partitionBy("session_id").orderBy("wide_start", "wide_end")) - F.col("wide_end")).alias("gap"))
    return g.agg(F.count("gap").alias("gaps"), F.expr("percentile(gap, 0.5)").alias("median"), F.round(F.count_if(F.col("gap") == 0) / F.count("gap"), 6).alias("zero_share"))


_ADJACENT = f"""{_WIDE}, br AS (SELECT w.session_id, wide_start, wide_end, count(*) FILTER (event_type = 'view') AS no, count(*) FILTER (event_type = 'purchase') AS nc, min(t) FILTER (event_type = 'view') AS o, min(t) FILTER (event_type = 'purchase') AS c
 FROM wide w JOIN a ON a.session_id = w.session_id AND t BETWEEN wide_start AND wide_end GROUP BY 1, 2, 3), ad AS (SELECT *, no = 1 AND nc = 1 AND o < c AS good, lead(wide_start) OVER w AS s2, lead(o) OVER w AS o2, lead(c) OVER w AS c2, lead(no = 1 AND nc = 1 AND o < c) OVER w AS good2 FROM br WINDOW w AS (PARTITION BY session_id ORDER BY wide_start, wide_end)),
pa AS (SELECT session_id, wide_end AS truth, c AS c1, o2, c - o AS l1, c2 - o2 AS l2 FROM ad WHERE good AND good2 AND abs(s2 - wide_end) <= {SECOND} AND o2 > c)"""


def _pairs(spark, sf_dir):
    """Neighbouring widened units that touch and hold one opening and one close each: ``truth, c1, o2, l1, l2``."""
    a = activity(spark, sf_dir)
    wide = B.expand(_units(spark, sf_dir), B.bounds(a, "session_id", "t"), "session_id", CAP, large=large_sessions(spark, sf_dir)).select("session_id", F.col("wide_start").alias("start_ts"), F.col("wide_end").alias("end_ts"))
    inside = I.containment(wide, a.select("session_id", "t", "event_type"), "session_id", "t", how="inner")
    view, buy = F.col("event_type") == "view", F.col("event_type") == "purchase"
    br = inside.groupBy("session_id", "start_ts", "end_ts").agg(F.count_if(view).alias("no"), F.count_if(buy).alias("nc"), F.min(F.when(view, F.col("t"))).alias("o"), F.min(F.when(buy, F.col("t"))).alias("c"))
    w = Window.partitionBy("session_id").orderBy("start_ts", "end_ts")
    br = br.withColumn("good", (F.col("no") == 1) & (F.col("nc") == 1) & (F.col("o") < F.col("c")))
    br = br.withColumns({n: F.lead(c).over(w) for n, c in (("s2", "start_ts"), ("o2", "o"), ("c2", "c"), ("good2", "good"))})
    br = br.where("good and good2 and o2 > c").where(F.abs(F.col("s2") - F.col("end_ts")) <= SECOND)
    return br.select("session_id", F.col("end_ts").alias("truth"), F.col("c").alias("c1"), "o2", (F.col("c") - F.col("o")).alias("l1"), (F.col("c2") - F.col("o2")).alias("l2"))


@query(f"{_ADJACENT} SELECT count(*) AS n, round(quantile_cont(abs((c1 + o2) / 2 - truth), 0.5), 3) AS midpoint, round(quantile_cont(abs(c1 + (o2 - c1) * CAST(l1 AS DOUBLE) / (l1 + l2) - truth), 0.5), 3) AS proportional FROM pa")
def boundary_placement(spark, sf_dir):
    """Median error of two places for a boundary in the gap between two units: its middle, and by their lengths."""
    c1, o2, truth = F.col("c1"), F.col("o2"), F.col("truth")
    p = _pairs(spark, sf_dir).select(F.abs((c1 + o2) / 2 - truth).alias("m"), F.abs(c1 + (o2 - c1) * F.col("l1").cast("double") / (F.col("l1") + F.col("l2")) - truth).alias("p"))
    return p.agg(F.count("*").alias("n"), F.round(F.expr("percentile(m, 0.5)"), 3).alias("midpoint"), F.round(F.expr("percentile(p, 0.5)"), 3).alias("proportional"))


@query(f"""{_ADJACENT}, fi AS (SELECT pa.session_id, truth, min(t) AS nt FROM pa JOIN a ON a.session_id = pa.session_id AND t >= truth GROUP BY 1, 2)
SELECT event_type, count(*) AS n, quantile_cont(nt - truth, 0.5) AS median_offset, count(*) FILTER (nt - truth <= {HOUR}) AS soon FROM fi JOIN a ON a.session_id = fi.session_id AND a.t = nt GROUP BY 1""")
def first_after_boundary(spark, sf_dir):
    """The kind of the first event at or after each boundary between such units, and how far off it is."""
    targets = activity(spark, sf_dir).select("session_id", F.col("t").alias("at"), F.col("event_type").alias("value"))
    f = asof(_pairs(spark, sf_dir), "session_id", "truth", targets, "at", "value").where("after is not null").withColumn("off", F.col("after.at") - F.col("truth"))
    return f.groupBy(F.col("after.value").alias("event_type")).agg(F.count("*").alias("n"), F.expr("percentile(off, 0.5)").alias("median_offset"), F.count_if(F.col("off") <= HOUR).alias("soon"))


@query(f"""WITH {LOG_SQL}, {_units_sql()}, {_RUNS}, {_ANCHORS} SELECT source, count(*) AS n, count(*) FILTER (ts_ms BETWEEN start_ts AND end_ts) AS inside FROM an JOIN ex ON ex.session_id = an.session_id AND ex."case" = an."case" GROUP BY 1""")
def case_in_window(spark, sf_dir):
    """Anchors whose session has an execution of their case, and those that fall into it."""
    j = anchors(spark, sf_dir).join(_runs(spark, sf_dir), ["session_id", "case"])
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("ts_ms").between(F.col("start_ts"), F.col("end_ts"))).alias("inside"))


@query(f"""WITH {_units_sql()}, c AS (SELECT u.session_id, start_ts, end_ts, k, count(*) AS n, min(t) AS first FROM units u JOIN a ON a.session_id = u.session_id AND t BETWEEN start_ts AND end_ts GROUP BY 1, 2, 3, 4), h AS (SELECT c.*, p_name FROM c JOIN part ON p_partkey = k AND p_size % 2 = 0)
SELECT session_id, start_ts, end_ts, k AS row_id, p_name FROM h QUALIFY row_number() OVER (PARTITION BY session_id, start_ts, end_ts ORDER BY n DESC, first, k) = 1""")
def row_lookup(spark, sf_dir):
    """The worklist row that a unit processed: of its cases, by falling number and first sight, the first that exists."""
    inside = I.containment(_units(spark, sf_dir), activity(spark, sf_dir).select("session_id", "t", "k"), "session_id", "t", how="inner")
    c = inside.groupBy("session_id", "start_ts", "end_ts", "k").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    h = c.join(table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("k"), "p_name"), "k")
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "k", "p_name")).alias("b")
    return h.groupBy("session_id", "start_ts", "end_ts").agg(best).select("session_id", "start_ts", "end_ts", F.col("b.k").alias("row_id"), "b.p_name")


@query(f"""WITH {_units_sql()}, p AS (SELECT u.session_id, start_ts, end_ts, min(t) AS press FROM units u JOIN a ON a.session_id = u.session_id AND event_type = 'click' AND t BETWEEN start_ts AND end_ts GROUP BY 1, 2, 3),
n AS (SELECT p.*, (SELECT min(t) FROM a WHERE a.session_id = p.session_id AND event_type = 'signup' AND t >= press) AS nx FROM p) SELECT session_id, start_ts, end_ts, press, CASE WHEN nx - press <= {15 * HOUR} THEN nx - press END AS delay FROM n""")
def first_press_confirmed(spark, sf_dir):
    """The first press inside each unit, and how soon a confirmation follows, fifteen hours at most."""
    a = activity(spark, sf_dir)
    inside = I.containment(_units(spark, sf_dir), a.where("event_type = 'click'").select("session_id", "t"), "session_id", "t", how="inner")
    p = inside.groupBy("session_id", "start_ts", "end_ts").agg(F.min("t").alias("press"))
    t = a.where("event_type = 'signup'").select("session_id", F.col("t").alias("at"), F.col("k").alias("value"))
    delay = F.col("after.at") - F.col("press")
    return asof(p, "session_id", "press", t, "at", "value").select("session_id", "start_ts", "end_ts", "press", F.when(delay <= 15 * HOUR, delay).alias("delay"))


@query(f"""WITH {_units_sql()}, s AS (SELECT a.session_id, event_id, t, (SELECT max(start_ts) FROM units u WHERE u.session_id = a.session_id AND start_ts <= a.t) AS s FROM a)
SELECT s.session_id, event_id, s.s AS start_ts, t <= (SELECT max(end_ts) FROM units u WHERE u.session_id = s.session_id AND u.start_ts = s.s) AS inside FROM s WHERE s.s IS NOT NULL""")
def point_to_interval(spark, sf_dir):
    """The last unit that begins up to each event, and whether it reaches it: an as-of join with a residual."""
    u = _units(spark, sf_dir).groupBy("session_id", "start_ts").agg(F.max("end_ts").alias("end_ts")).select("session_id", F.col("start_ts").alias("at"), F.col("end_ts").alias("value"))
    p = asof(activity(spark, sf_dir).select("session_id", "event_id", "t"), "session_id", "t", u, "at", "value").where("before is not null")
    return p.select("session_id", "event_id", F.col("before.at").alias("start_ts"), (F.col("t") <= F.col("before.value")).alias("inside"))


@query(f"""{_WIDE}, n AS (SELECT u.session_id, start_ts, end_ts, lag(end_ts) OVER w AS pe, lead(start_ts) OVER w AS ns, t0, t1 FROM units u JOIN b USING (session_id) WINDOW w AS (PARTITION BY u.session_id ORDER BY start_ts, end_ts)),
f AS (SELECT *, (SELECT min(t) FROM a WHERE a.session_id = n.session_id AND event_type = 'signup' AND t > pe AND t < start_ts) AS sb, (SELECT min(t) FROM a WHERE a.session_id = n.session_id AND event_type = 'signup' AND t > end_ts AND t < ns) AS sf FROM n)
SELECT session_id, start_ts, end_ts, CAST(start_ts - greatest(0, least(coalesce(start_ts - sb, floor((start_ts - coalesce(pe, t0)) / 2)), {CAP})) AS BIGINT) AS wide_start, CAST(end_ts + greatest(0, least(coalesce(sf - end_ts, floor((coalesce(ns, t1) - end_ts) / 2)), {CAP})) AS BIGINT) AS wide_end FROM f""")
def switch_split(spark, sf_dir):
    """Units widened to the first switch of the application in the gap to a neighbour, else to the gap's middle."""
    a, w = activity(spark, sf_dir), Window.partitionBy("session_id").orderBy("start_ts", "end_ts")
    n = _units(spark, sf_dir).select("session_id", "start_ts", "end_ts", F.lag("end_ts").over(w).alias("pe"), F.lead("start_ts").over(w).alias("ns")).join(B.bounds(a, "session_id", "t"), "session_id")
    switches = a.where("event_type = 'signup'").select("session_id", F.col("t").alias("at"), F.col("k").alias("value"))
    for name, after, before in (("sb", "pe", "start_ts"), ("sf", "end_ts", "ns")):
        n = asof(n.withColumn("_from", F.col(after) + 1), "session_id", "_from", switches, "at", "value")
        n = n.withColumn(name, F.when(F.col(after).isNotNull() & (F.col("after.at") < F.col(before)), F.col("after.at"))).drop("before", "after", "_from")
    part = lambda c: F.greatest(F.lit(0), F.least(c, F.lit(CAP)))
    back = F.coalesce(F.col("start_ts") - F.col("sb"), F.floor((F.col("start_ts") - F.coalesce("pe", "t0")) / 2))
    ahead = F.coalesce(F.col("sf") - F.col("end_ts"), F.floor((F.coalesce("ns", "t1") - F.col("end_ts")) / 2))
    return n.select("session_id", "start_ts", "end_ts", (F.col("start_ts") - part(back)).alias("wide_start"), (F.col("end_ts") + part(ahead)).alias("wide_end"))


def _delivered_sql() -> str:
    from .catalogue import _SQL

    return f"{_SQL['bracket_tail'].rsplit(' SELECT * FROM tail', 1)[0]}, de AS (SELECT session_id, wide_start AS start_ts, wide_end AS end_ts, 'bracket' AS part FROM wide UNION ALL SELECT session_id, start_ts, end_ts, CASE WHEN session_id IN (SELECT session_id FROM lc) THEN 'tail' ELSE 'fallback' END FROM tail WHERE end_ts - start_ts >= {MIN_UNIT})"


@query(f"{_delivered_sql()} SELECT * FROM de")
def delivered_segments(spark, sf_dir):
    """The whole segmentation: widened units, what follows a session's last close, and sessions without any close."""
    a = activity(spark, sf_dir)
    wide = B.expand(_units(spark, sf_dir), B.bounds(a, "session_id", "t"), "session_id", CAP, large=large_sessions(spark, sf_dir)).select("session_id", F.col("wide_start").alias("start_ts"), F.col("wide_end").alias("end_ts"), F.lit("bracket").alias("part"))
    closed = a.where("event_type = 'purchase'").select("session_id", F.lit(True).alias("closed")).distinct()
    tail = bracket_tail(spark, sf_dir).join(closed, "session_id", "left")
    return wide.unionByName(tail.select("session_id", "start_ts", "end_ts", F.when(F.col("closed"), "tail").otherwise("fallback").alias("part")))


@query(f"{_delivered_sql()}, s AS (SELECT *, lead(start_ts) OVER (PARTITION BY session_id ORDER BY start_ts, end_ts) AS nx FROM de) SELECT part, count(*) AS n, count(*) FILTER (end_ts <= start_ts) AS empty, count(*) FILTER (nx < end_ts) AS overlaps FROM s GROUP BY 1")
def delivered_checks(spark, sf_dir):
    """Of each part of the segmentation: segments, those without length, and those that the next one overlaps."""
    nx = F.lead("start_ts").over(Window.partitionBy("session_id").orderBy("start_ts", "end_ts"))
    s = delivered_segments(spark, sf_dir).withColumn("nx", nx)
    return s.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.expr("end_ts <= start_ts")).alias("empty"), F.count_if(F.coalesce(F.expr("nx < end_ts"), F.lit(False))).alias("overlaps"))


@query(f"""{_L}, {_SYSTEMS}, h AS (SELECT unnest(['System 0', 'System 1', 'Archive']) AS system), f AS (SELECT system FROM sy) SELECT 'both' AS side, system FROM (SELECT * FROM h INTERSECT SELECT * FROM f) UNION ALL SELECT 'hand only', system FROM (SELECT * FROM h EXCEPT SELECT * FROM f)
UNION ALL SELECT 'found only', system FROM (SELECT * FROM f EXCEPT SELECT * FROM h)""")
def vocabulary_compare(spark, sf_dir):
    """A vocabulary written by hand against the discovered one: intersection, and the difference both ways."""
    hand = spark.createDataFrame([("System 0",), ("System 1",), ("Archive",)], "system string")
    found = systems(log(spark, sf_dir)).select("system")
    side = lambda df, name: df.select(F.lit(name).alias("side"), "system")
    return side(hand.intersect(found), "both").unionByName(side(hand.subtract(found), "hand only")).unionByName(side(found.subtract(hand), "found only"))


@query(f"""{_L}, g AS (SELECT event_type, ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS gap FROM l) SELECT event_type, count(gap) AS n, quantile_cont(gap, 0.5) AS p50, quantile_cont(gap, 0.9) AS p90, quantile_cont(gap, 0.99) AS p99 FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def gap_quantiles(spark, sf_dir):
    """Quantiles of the time since the event before, by kind of event."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("session_id").orderBy("ts_ms", "event_id"))
    g = log(spark, sf_dir).select("event_type", gap.alias("gap")).where("gap is not null")
    q = U.linear_quantiles(g, "event_type", "gap", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return g.groupBy("event_type").agg(F.count("*").alias("n")).join(q, "event_type")


@query(f"""{_LU}, {_STATES}, {_LABELS}, sl AS (SELECT DISTINCT split_part(label, '__', 2) AS screen, label FROM lb2) SELECT 'labels of a screen' AS side, screen AS name, count(*) AS n FROM sl GROUP BY screen UNION ALL SELECT 'screens of a label', label, count(*) FROM sl GROUP BY label""")
def one_to_one(spark, sf_dir):
    """How many labels each screen has, and how many screens each label."""
    d = labelled(spark, sf_dir).select(F.get(F.split("label", "__"), F.lit(1)).alias("screen"), "label").distinct()
    of = lambda c, side: d.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "name", "n")
    return of("screen", "labels of a screen").unionByName(of("label", "screens of a label"))


@query(f"""{_LU}, {_STATES}, {_LABELS}, v AS (SELECT split_part(label, '__', 1) AS family, label, end_ts - start_ts AS spent, session_id, start_ts, end_ts FROM lb2), c AS (SELECT family, app, count(*) AS n FROM v JOIN l ON l.session_id = v.session_id AND ts_ms BETWEEN start_ts AND end_ts GROUP BY 1, 2),
t AS (SELECT family, string_agg(app, ',' ORDER BY n DESC, app) AS top_apps FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, app) <= 2) GROUP BY 1)
SELECT v.family, count(*) AS n, count(DISTINCT label) AS variants, quantile_cont(spent, 0.5) AS median, quantile_cont(spent, 0.9) AS p90, any_value(top_apps) AS top_apps FROM v LEFT JOIN t ON t.family = v.family GROUP BY 1""")
def family_profile(spark, sf_dir):
    """Families of labels: runs, variants, median and 90 % point of the time, and the two applications used most."""
    u = labelled(spark, sf_dir).withColumn("family", F.get(F.split("label", "__"), F.lit(0)))
    apps = I.containment(u.select("session_id", "start_ts", "end_ts", "family"), log(spark, sf_dir).select("session_id", "ts_ms", "app"), "session_id", "ts_ms", DAY_MS, "inner")
    c = apps.groupBy("family", "app").agg(F.count("*").alias("n"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "app"))).where("r <= 2")
    top = c.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "app"))), lambda x: x["app"]), ",").alias("top_apps"))
    u = u.withColumn("spent", F.col("end_ts") - F.col("start_ts"))
    q = U.linear_quantiles(u, "family", "spent", {"median": 0.5, "p90": 0.9})
    return u.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("label").alias("variants")).join(q, "family").join(top, "family", "left")


#: Least score of an edge, and time between two edges of a kind.
LEAST, APART = 0.3, HOUR


def _tagged(spark, sf_dir):
    """Events with their features, and the edge that each labels (0: none)."""
    f = event_features(spark, sf_dir).drop("session_id").withColumn("event_id", F.substring("event_id", 2, 20).cast("bigint"))
    d = activity(spark, sf_dir).select("session_id", "t", "event_id").join(f, "event_id")
    labels = edge_labels(spark, sf_dir)
    return d.join(labels, ["session_id", "t"], "left").withColumn("cls", F.coalesce("cls", F.lit(0)))


@query()
def learned_brackets(spark, sf_dir):
    """Units between learned edges, against gap sessions as a plain baseline: boundary scores of each half of the sessions,
    whose model comes from the other half.  Edges are scored by boosted trees, thinned by suppression and paired.  A
    model has no SQL; tests check its parts and that it beats the baseline."""
    d = keep(_tagged(spark, sf_dir), "tagged")
    columns = [c for c in d.columns if c not in ("session_id", "t", "event_id", "cls")]
    mine = lambda half: F.pmod("session_id", F.lit(2)) == half
    parts = [M.boosted_scores(d.where(mine(1 - h)), d.where(mine(h)), "cls", [1, 2], columns, rounds=10) for h in (0, 1)]
    scored = keep(parts[0].unionByName(parts[1]).select("session_id", "t", "score_1", "score_2"), "scored")
    events = scored.select("session_id", "t", F.lit(0).alias("cls"))
    for cls in (1, 2):
        edges = non_max(scored.where(F.col(f"score_{cls}") >= LEAST), "session_id", "t", f"score_{cls}", APART)
        events = events.unionByName(edges.withColumn("cls", F.lit(cls)))
    units = B.bracket_pairs(events, "session_id", "t", F.col("cls") == 1, F.col("cls") == 2, MAX_UNIT, MIN_UNIT)
    bounds, large = B.bounds(activity(spark, sf_dir), "session_id", "t"), large_sessions(spark, sf_dir)
    gold, half = _edge_rows(_units(spark, sf_dir), bounds), F.pmod("session_id", F.lit(2)).alias("half")
    rows = []
    for arm, found in (("learned", units), ("gaps", _pred(spark, sf_dir))):
        m = P.matched_boundaries(gold, _edge_rows(found, bounds), bounds, ["session_id"], (2, 5, 10), large=large)
        rows.append(m.groupBy(F.lit(arm).alias("arm"), half, "tol").agg(*[F.sum(c).alias(c) for c in ("tp", "n_gold", "n_pred")]))
    return rows[0].unionByName(rows[1]).withColumns(P.prf(F.col("tp"), F.col("n_gold"), F.col("n_pred")))
