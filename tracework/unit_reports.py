"""Registered queries on units and their neighbourhood: tails, fallbacks, confirmations, errors, shares."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _SQL, _WIDE, CAP, HOUR, MAX_UNIT, MIN_UNIT, SNAP, _A, _units, _units_sql, large_sessions, query
from .functions.text import element_prefix
from .operators import brackets as B
from .operators import grid as G
from .operators import intervals as I
from .operators import learn as L
from .operators.linkage import linked_clusters
from .reports import _BD, _bounds, _targets
from .sources.event_log import activity, scratch, table
from .sources.layout import laid_out, lay_out

#: The steps of the grid units from ``bd`` on, for other bounds.
_CELLS = _SQL["grid_units"].split(_BD + ", ", 1)[1].rsplit("SELECT session_id, start_ts", 1)[0]


@query(f"""{_WIDE}, lc AS (SELECT session_id, max(t) AS lc FROM a WHERE event_type = 'purchase' GROUP BY 1), fl AS (SELECT session_id, max(wide_end) AS fl FROM wide GROUP BY 1),
bd AS (SELECT b.session_id, coalesce(lc, t0) AS t0, t1, lc FROM b LEFT JOIN lc USING (session_id)), {_CELLS},
tail AS (SELECT z.session_id, CASE WHEN lc IS NULL THEN start_ts ELSE greatest(start_ts, coalesce(fl, lc)) END AS start_ts, CASE WHEN lc IS NULL THEN end_ts ELSE least(end_ts, t1) END AS end_ts, label
FROM z JOIN bd USING (session_id) LEFT JOIN fl USING (session_id) WHERE end_ts > start_ts) SELECT * FROM tail WHERE end_ts - start_ts >= {MIN_UNIT}""")
def bracket_tail(spark, sf_dir):
    """Grid units after a session's last close, cut at the widened units before them; of a session without any
    close, over all of it."""
    a, bounds = activity(spark, sf_dir), _bounds(spark, sf_dir)
    closes = a.where("event_type = 'purchase'").groupBy("session_id").agg(F.max("t").alias("lc"))
    wide = B.expand(_units(spark, sf_dir), bounds, "session_id", CAP, large=large_sessions(spark, sf_dir)).groupBy("session_id").agg(F.max("wide_end").alias("fl"))
    span = bounds.join(closes, "session_id", "left").withColumn("t0", F.coalesce("lc", "t0"))
    units = G.grid_units(span, _targets(spark, sf_dir, "click"), _targets(spark, sf_dir, "signup"), "session_id", HOUR, 24 * HOUR, SNAP)
    u = units.join(span.join(wide, "session_id", "left"), "session_id")
    none = F.col("lc").isNull()
    start = F.when(none, F.col("start_ts")).otherwise(F.greatest("start_ts", F.coalesce("fl", "lc")))
    end = F.when(none, F.col("end_ts")).otherwise(F.least("end_ts", "t1"))
    return u.select("session_id", start.alias("start_ts"), end.alias("end_ts"), "label").where(F.col("end_ts") - F.col("start_ts") >= MIN_UNIT)


_CASES = f"""WITH {_units_sql()}, c AS (SELECT u.session_id, start_ts, end_ts, k, count(*) AS n FROM units u JOIN a ON a.session_id = u.session_id AND event_type = 'click' AND t BETWEEN start_ts AND end_ts GROUP BY 1, 2, 3, 4),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session_id, start_ts, end_ts ORDER BY n DESC, k) = 1)"""


@query(_CASES + """ SELECT u.session_id, u.start_ts, u.end_ts, coalesce(CAST(m.k AS VARCHAR), CAST((SELECT max_by(k, t) FROM a WHERE a.session_id = u.session_id AND event_type = 'click' AND t <= u.end_ts) AS VARCHAR),
CAST((SELECT min_by(k, t) FROM a WHERE a.session_id = u.session_id AND event_type = 'click' AND t >= u.end_ts) AS VARCHAR), '?') AS case_id FROM units u LEFT JOIN m USING (session_id, start_ts, end_ts)""")
def segment_case_fallback(spark, sf_dir):
    """The modal case inside a unit, else the last one before its close, else the first one after it, else '?'."""
    units, clicks = _units(spark, sf_dir), activity(spark, sf_dir).where("event_type = 'click'")
    mode = I.containment(units, clicks.select("session_id", "t", "k"), "session_id", "t").groupBy("session_id", "start_ts", "end_ts").agg(F.expr("mode(k, true)").alias("m"))
    near = G.asof(mode, "session_id", "end_ts", _targets(spark, sf_dir, "click"), "at", "value")
    case = F.coalesce(F.col("m").cast("string"), F.col("before.value").cast("string"), F.col("after.value").cast("string"), F.lit("?"))
    return near.select("session_id", "start_ts", "end_ts", case.alias("case_id"))


@query(f"""WITH {_A}, p AS (SELECT *, (SELECT min(t) FROM a q WHERE q.session_id = a.session_id AND q.event_type = 'view' AND q.t >= a.t) AS nx FROM a WHERE event_type = 'purchase')
SELECT session_id, event_id, coalesce(nx <= t + {12 * HOUR}, false) AS confirmed, CASE WHEN nx <= t + {12 * HOUR} THEN nx - t END AS delay FROM p""")
def confirm_within(spark, sf_dir):
    """Whether a view follows each purchase within twelve hours, and how soon."""
    p = activity(spark, sf_dir).where("event_type = 'purchase'").select("session_id", "event_id", "t")
    delay = F.col("after.at") - F.col("t")
    n = G.asof(p, "session_id", "t", _targets(spark, sf_dir, "view"), "at", "value").withColumn("d", F.when(delay <= 12 * HOUR, delay))
    return n.select("session_id", "event_id", F.col("d").isNotNull().alias("confirmed"), F.col("d").alias("delay"))


@query(f"""WITH {_units_sql()}, s AS (SELECT u.session_id, start_ts, end_ts, count(*) FILTER (event_type = 'click') > 0 AS has_click, count(*) FILTER (event_type = 'error') > 0 AS has_error, count(DISTINCT k) = 1 AS one
FROM units u LEFT JOIN a ON a.session_id = u.session_id AND t BETWEEN start_ts AND end_ts GROUP BY 1, 2, 3) SELECT has_click, has_error, count(*) AS n, count(*) FILTER (one) AS n_one, CAST(sum(end_ts - start_ts) AS BIGINT) AS spent FROM s GROUP BY 1, 2""")
def error_table(spark, sf_dir):
    """Units by what they hold, how many of them hold one case only, and the time spent in them."""
    s = I.containment(_units(spark, sf_dir), activity(spark, sf_dir), "session_id", "t").groupBy("session_id", "start_ts", "end_ts").agg(
        (F.count_if(F.col("event_type") == "click") > 0).alias("has_click"),
        (F.count_if(F.col("event_type") == "error") > 0).alias("has_error"),
        (F.count_distinct("k") == 1).alias("one"),
    )
    return s.groupBy("has_click", "has_error").agg(F.count("*").alias("n"), F.count_if("one").alias("n_one"), F.sum(F.col("end_ts") - F.col("start_ts")).alias("spent"))


@query(f"""WITH {_units_sql()}, q AS (SELECT session_id FROM a GROUP BY 1 HAVING count(*) FILTER (event_type = 'signup') = 0)
SELECT count(*) AS n_units, count(*) FILTER (session_id IN (SELECT session_id FROM q)) AS n_quiet, round(sum(CASE WHEN session_id IN (SELECT session_id FROM q) THEN end_ts - start_ts ELSE 0 END) / sum(end_ts - start_ts), 6) AS quiet_share FROM units""")
def quiet_session_share(spark, sf_dir):
    """Share of unit time in sessions that never show one kind of event."""
    quiet = activity(spark, sf_dir).groupBy("session_id").agg((F.count_if(F.col("event_type") == "signup") == 0).alias("quiet"))
    u = _units(spark, sf_dir).join(quiet, "session_id").withColumn("d", F.col("end_ts") - F.col("start_ts"))
    return u.agg(F.count("*").alias("n_units"), F.count_if("quiet").alias("n_quiet"), F.round(F.sum(F.when(F.col("quiet"), F.col("d")).otherwise(0)) / F.sum("d"), 6).alias("quiet_share"))


@query(f"""WITH {_A}, v AS (SELECT k, event_type, session_id, count(*) AS n FROM a GROUP BY 1, 2, 3), t AS (SELECT k, event_type, sum(n) AS n FROM v GROUP BY 1, 2),
s AS (SELECT DISTINCT session_id, k FROM v), o AS (SELECT s.session_id, s.k, t.event_type, t.n - coalesce(v.n, 0) AS votes FROM s JOIN t USING (k) LEFT JOIN v ON v.session_id = s.session_id AND v.k = s.k AND v.event_type = t.event_type),
b AS (SELECT * FROM o WHERE votes > 0 QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY votes DESC, event_type) = 1)
SELECT session_id, CAST(sum(v.n) AS BIGINT) AS n, CAST(coalesce(sum(v.n) FILTER (v.event_type = b.event_type), 0) AS BIGINT) AS hits FROM v LEFT JOIN b USING (session_id, k) GROUP BY 1""")
def held_out_majority(spark, sf_dir):
    """How often the majority map of all other sessions names an event's kind: totals less the session's own votes."""
    v = activity(spark, sf_dir).groupBy("session_id", "k", "event_type").agg(F.count("*").alias("n"))
    t = v.groupBy("k", "event_type").agg(F.sum("n").alias("total"))
    own = v.groupBy("session_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("own"))
    o = own.join(t, "k").withColumn("votes", F.col("total") - F.coalesce(F.try_element_at("own", F.col("event_type")), F.lit(0)))
    best = o.where("votes > 0").groupBy("session_id", "k").agg(F.min(F.struct((-F.col("votes")).alias("v"), "event_type")).alias("b"))
    j = v.join(best, ["session_id", "k"], "left")
    return j.groupBy("session_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("event_type") == F.col("b.event_type"), F.col("n"))), F.lit(0)).alias("hits"))


@query("""WITH p AS (SELECT l_shipmode_key, n, round(100.0 * n / sum(n) OVER (), 4) AS share FROM (SELECT l_linenumber AS l_shipmode_key, count(*) AS n FROM lineitem GROUP BY 1))
SELECT l_shipmode_key AS line, n, share, row_number() OVER (ORDER BY n DESC, l_shipmode_key) AS place, (SELECT count(*) FROM p q WHERE abs(round(q.share * 10000) - round(p.share * 10000)) <= 20000) AS n_near FROM p""")
def standing(spark, sf_dir):
    """Place of each class by count, and how many classes (itself included) stand within two points."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"))
    p = p.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # one row a class
    near = F.count("*").over(Window.orderBy(F.round(F.col("share") * 10_000).cast("bigint")).rangeBetween(-20_000, 20_000))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "line"))
    return p.select("line", "n", "share", place.cast("bigint").alias("place"), near.alias("n_near"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(grouping(o_orderpriority, o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('btn-', replace(p_name, ' ', '-')) ELSE replace(p_name, ' ', '-') END AS e FROM part)
SELECT p_partkey, CASE WHEN e LIKE 'btn-%' THEN split_part(e, '-', 2) ELSE split_part(e, '-', 1) END AS prefix FROM x""")
def element_prefixes(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    e = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("btn-"), name)).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", element_prefix(e).alias("prefix"))


def _bags(spark, sf_dir):
    """Units with the kinds and numbers of their events as tokens."""
    inside = I.containment(_units(spark, sf_dir), activity(spark, sf_dir), "session_id", "t")
    token = F.concat_ws("_", "event_type", F.col("k").cast("string"))
    return inside.groupBy("session_id", "start_ts", "end_ts").agg(F.sort_array(F.collect_list(token)).alias("tokens"))


@query()
def unit_clusters(spark, sf_dir):
    """Units in eight clusters by the kinds and numbers of their events."""
    return L.token_clusters(_bags(spark, sf_dir), "tokens", 8).select("session_id", "start_ts", "end_ts", "cluster")


@query()
def unit_linkage(spark, sf_dir):
    """Units in eight clusters by single linkage, those below a similarity of 0.3 apart; named by their first unit."""
    bags = _bags(spark, sf_dir).withColumn("unit", F.concat_ws(":", "session_id", "start_ts", "end_ts"))
    return linked_clusters(bags, "unit", "tokens", 8, 0.3).select("session_id", "start_ts", "end_ts", "cluster")


@query(f"""WITH {_units_sql()} SELECT 'with openings' AS setting, session_id, start_ts, end_ts, has_open FROM units
UNION ALL SELECT 'without', * FROM (WITH {_units_sql(False)} SELECT * FROM units)""")
def stored_brackets(spark, sf_dir):
    """Units in two settings off one log that is laid out first: neither setting shuffles it again."""
    path = scratch(spark, "layout")
    name, kind = os.path.basename(path).replace("-", "_"), F.col("event_type")
    lay_out(activity(spark, sf_dir), name, ["session_id"], "t", MAX_UNIT, 16, path)
    a = laid_out(spark, name, ["session_id"], "t", MAX_UNIT)
    units = [B.bracket_pairs(a, "session_id", "t", kind == "view", kind == "purchase", MAX_UNIT, MIN_UNIT, opens) for opens in (True, False)]
    return units[0].select(F.lit("with openings").alias("setting"), "*").unionByName(units[1].select(F.lit("without").alias("setting"), "*"))
