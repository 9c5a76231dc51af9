"""Registered queries on the desktop log: ingest, vocabulary, anchors, states, labels and documents of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import _SQL, HOUR, MAX_UNIT, MIN_UNIT, _units, _units_sql, query
from . import desk
from .desk import LOG_SQL, log, raw_log, scratch, write_raw
from .functions.text import case_ids, element_prefix, url_route
from .operators import audits as U
from .operators import intervals as I
from .operators import labels as L
from .operators.scan import large_keys
from .sources import event_log as S

_L = f"WITH {LOG_SQL}"
#: Units in milliseconds, with the session names of the log.
_MS = "um AS (SELECT concat('ses_', session_id) AS session_id, start_ts // 1000 AS start_ts, end_ts // 1000 AS end_ts FROM units)"
_LU = f"WITH {LOG_SQL}, {_units_sql()}, {_MS}"
DAY_MS = 86_400_000
ID = r"[A-Z]{1,6}\d*-\d{2,10}-\d{1,6}"


def units_ms(spark, sf_dir) -> DataFrame:
    ms = lambda c: F.expr(f"{c} div 1000").alias(c)
    return _units(spark, sf_dir).select(F.concat(F.lit("ses_"), F.col("session_id").cast("string")).alias("session_id"), ms("start_ts"), ms("end_ts"))


def large_sessions(spark, sf_dir) -> DataFrame | None:
    """Sessions of the log that windows have to cut."""
    return large_keys(log(spark, sf_dir).select("session_id"), ["session_id"])


def _texts(spark, sf_dir) -> DataFrame:
    return desk.texts(spark, sf_dir)


@query(f"{_L} SELECT * FROM l")
def log_flatten(spark, sf_dir):
    """The nested log written as JSON lines in folders, read again and flattened to 35 columns."""
    return S.require_rows(S.read_log(spark, write_raw(spark, sf_dir)), "events")


@query(f"{_L} SELECT ds, session_id, chunk_id, event_id, row_number() OVER (PARTITION BY ds, session_id ORDER BY ts_ms, coalesce(seq, 0), event_id) AS place FROM l")
def log_places(spark, sf_dir):
    """The place of each event in its session, with the chunk whose folder held it."""
    raw = S.read_raw(spark, write_raw(spark, sf_dir))
    flat = S.flatten(raw.withColumn("_chunk", F.col("chunk")), F.col("ds"))
    chunks = raw.select("event_id", F.col("chunk").alias("folder"))
    w = Window.partitionBy("ds", "session_id").orderBy(*S.log_order(flat))
    out = flat.join(chunks, "event_id").withColumn("place", F.row_number().over(w).cast("bigint"))
    return out.select("ds", "session_id", F.col("folder").alias("chunk_id"), "event_id", "place")


@query(f"{_L} SELECT event_id, session_id, ts_ms, text FROM tx WHERE ds = 'd1'")
def dataset_texts(spark, sf_dir):
    """The text table as Parquet, restricted to the events of one data set; both tables are written by data set."""
    events, texts = scratch(spark, "events"), scratch(spark, "texts")
    log(spark, sf_dir).write.partitionBy("ds").parquet(events)
    S.texts(raw_log(spark, sf_dir)).write.parquet(texts)
    own = spark.read.parquet(events).where("ds = 'd1'").select("event_id")
    return spark.read.parquet(texts).join(own, "event_id", "left_semi").select("event_id", "session_id", "ts_ms", "text")


@query(f"""{_LU}, bs AS (SELECT session_id, min(ts_ms) AS t0, max(ts_ms) AS t1 FROM l GROUP BY 1), g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_ts, end_ts) AS i FROM um),
o AS (SELECT session_id, i, start_ts, CASE WHEN i % 3 <> 0 THEN end_ts END AS e, lead(start_ts) OVER (PARTITION BY session_id ORDER BY start_ts, i) AS nx FROM g)
SELECT session_id, 'P' || (i % 2) AS code, start_ts, least(coalesce(e, nx, t1), t1) AS end_ts, e IS NULL AS inferred_end FROM o JOIN bs USING (session_id) WHERE least(coalesce(e, nx, t1), t1) > start_ts""")
def gold_manifest(spark, sf_dir):
    """Executions of manifests (JSON, one per session, nested in two levels); an end that is missing is the next start,
    the session's end at most, and executions without length are dropped."""
    w = Window.partitionBy("session_id").orderBy("start_ts", "end_ts")
    u = units_ms(spark, sf_dir).withColumn("i", F.row_number().over(w))
    run = F.struct(F.col("start_ts"), F.when(F.col("i") % 3 != 0, F.col("end_ts")).alias("end_ts"), F.col("i").alias("seq"))
    codes = u.groupBy("session_id", F.concat(F.lit("P"), (F.col("i") % 2).cast("string")).alias("code")).agg(F.collect_list(run).alias("executions"))
    bounds = log(spark, sf_dir).groupBy("session_id").agg(F.min("ts_ms").alias("start_ts"), F.max("ts_ms").alias("end_ts"))
    manifests = codes.groupBy("session_id").agg(F.collect_list(F.struct("code", "executions")).alias("processes")).join(bounds.select("session_id", F.struct("start_ts", "end_ts").alias("session")), "session_id")
    path = scratch(spark, "manifests")
    manifests.write.json(path)
    return S.gold_runs(S.read_manifests(spark, path)).select("session_id", "code", "start_ts", "end_ts", "inferred_end")


@query(f"""{_LU} SELECT session_id, start_ts // 1000 * 1000 AS start_ms, end_ts // 1000 * 1000 AS end_ms, (end_ts // 1000 - start_ts // 1000) / 1.0 AS dur, 'unit' AS label FROM um""")
def segments_round_trip(spark, sf_dir):
    """Units as JSON lines of four fields, times in whole seconds, read again."""
    path, u = scratch(spark, "segments"), units_ms(spark, sf_dir)
    S.write_segments(u.select("session_id", (F.col("start_ts") * 1000).alias("start_ts"), (F.col("end_ts") * 1000).alias("end_ts"), F.lit("unit").alias("label")), path)
    return S.read_segments(spark, path).select("session_id", "start_ms", "end_ms", "dur", "label")


@query(f"""{_L} SELECT session_id, count(*) FILTER (el_tag = 'button') AS structural, count(*) FILTER (starts_with(el_id, 'btn-')) AS lexical, count(*) FILTER (el_tag = 'button' AND starts_with(el_id, 'btn-')) AS both,
count(*) FILTER (layer = 'L3') = 0 AS quiet FROM l GROUP BY 1""")
def terminator_rules(spark, sf_dir):
    """Clicks that end a unit, by the element's kind and by its name, and sessions the browser never reported."""
    button, named = F.coalesce(F.col("el_tag") == "button", F.lit(False)), F.coalesce(F.startswith("el_id", F.lit("btn-")), F.lit(False))
    return log(spark, sf_dir).groupBy("session_id").agg(
        F.count_if(button).alias("structural"), F.count_if(named).alias("lexical"), F.count_if(button & named).alias("both"), (F.count_if(F.col("layer") == "L3") == 0).alias("quiet")
    )


_HEAD = r"trim(regexp_replace(trim(split_part(title, ' - ', 1)), '\s+and\s+\d+\s+more\s+pages?$', ''))"
_SYSTEMS = f"""hd AS (SELECT *, {_HEAD} AS head FROM l WHERE title IS NOT NULL), sy AS (SELECT head AS system, count(*) AS n, count(DISTINCT session_id) AS sessions FROM hd WHERE app IN ('Google Chrome', 'Microsoft Edge') AND head <> ''
 AND head IN (SELECT head FROM hd WHERE el_tag = 'button') GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT session_id) >= 2)"""


def systems(flat: DataFrame, support: int = 20) -> DataFrame:
    """``system, n, sessions``: heads of browser titles with support, two sessions and a unit ended there."""
    d = flat.where("title is not null").withColumn("system", L.title_head(F.col("title")))
    worked = d.where("el_tag = 'button'").select("system").distinct()
    seen = d.where(F.col("app").isin("Google Chrome", "Microsoft Edge") & (F.col("system") != "")).join(worked, "system", "left_semi")
    return seen.groupBy("system").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions")).where((F.col("n") >= support) & (F.col("sessions") >= 2))


@query(f"{_L}, {_SYSTEMS} SELECT * FROM sy")
def discovered_systems(spark, sf_dir):
    return systems(log(spark, sf_dir))


_PREFIX = "CASE WHEN starts_with(el_id, 'btn-') THEN split_part(el_id, '-', 2) ELSE split_part(el_id, '-', 1) END"
_ROUTES = f"""rt AS (SELECT *, nullif(regexp_extract(url, '#/([\\w-]+)', 1), '') AS route, {_PREFIX} AS prefix FROM l), pv AS (SELECT prefix, route, count(*) AS votes FROM rt WHERE el_id IS NOT NULL AND route IS NOT NULL AND prefix <> '' GROUP BY 1, 2),
pr AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY votes DESC, route) = 1 AND votes >= 5)"""


def prefixes(flat: DataFrame) -> DataFrame:
    d = flat.where("el_id is not null").select(element_prefix(F.col("el_id")).alias("prefix"), url_route(F.col("url")).alias("route"))
    from .operators.rules import majority

    return majority(d.where("prefix <> ''"), "prefix", "route", 5)


@query(f"{_L}, {_ROUTES} SELECT * FROM pr")
def screen_prefixes(spark, sf_dir):
    """The route that each prefix of element ids stands for, by most votes."""
    return prefixes(log(spark, sf_dir))


_NOTES = f"""{_ROUTES}, nt AS (SELECT trim(el_name) AS text, pr.route, count(*) AS votes FROM rt JOIN pr ON pr.prefix = rt.prefix WHERE el_id IS NOT NULL AND el_name IS NOT NULL GROUP BY 1, 2),
ph AS (SELECT * FROM nt QUALIFY count(*) OVER (PARTITION BY text) = 1 AND votes >= 5)"""


def placeholders(flat: DataFrame) -> DataFrame:
    from .operators.rules import majority

    d = flat.where("el_id is not null and el_name is not null").select(element_prefix(F.col("el_id")).alias("prefix"), L.strip(F.col("el_name")).alias("text"))
    return majority(d.join(F.broadcast(prefixes(flat).select("prefix", "route")), "prefix"), "text", "route", 5, unanimous=True)  # a row a prefix of element ids


@query(f"{_L}, {_NOTES} SELECT * FROM ph")
def placeholder_routes(spark, sf_dir):
    """Texts that stand on one screen only, with its route."""
    return placeholders(log(spark, sf_dir))


@query(f"""{_L}, {_ROUTES}, n AS (SELECT route, count(*) AS n, count(*) FILTER (el_tag = 'button') AS closes FROM rt WHERE route IS NOT NULL GROUP BY 1)
SELECT route, n, closes, round(closes / greatest((SELECT sum(closes) FROM n), 1), 6) AS share FROM n WHERE closes < 0.03 * greatest((SELECT sum(closes) FROM n), 1)""")
def non_route_share(spark, sf_dir):
    """Routes where hardly any unit ends: less than 3 % of all terminators; without any terminator, all routes."""
    d = log(spark, sf_dir).select(url_route(F.col("url")).alias("route"), (F.col("el_tag") == "button").alias("close")).where("route is not null")
    n = d.groupBy("route").agg(F.count("*").alias("n"), F.count_if("close").alias("closes"))
    total = n.agg(F.greatest(F.sum("closes"), F.lit(1)).alias("total"))  # one row
    n = n.crossJoin(F.broadcast(total))
    return n.where(F.col("closes") < 0.03 * F.col("total")).select("route", "n", "closes", F.round(F.col("closes") / F.col("total"), 6).alias("share"))


_ANCHORS = rf"""ti AS (SELECT event_id, session_id, ts_ms, length(text) AS len, unnest(regexp_extract_all(text, '\b{ID}\b')) AS "case", generate_subscripts(regexp_extract_all(text, '\b{ID}\b'), 1) AS pos FROM tx),
tc AS (SELECT event_id, session_id, ts_ms, len, "case", count(*) AS n, min(pos) AS pos FROM ti GROUP BY ALL), tr AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, pos) AS r, count(*) OVER (PARTITION BY event_id) AS c FROM tc),
nm AS (SELECT session_id, ts_ms, trim(el_name) AS name FROM l WHERE el_name IS NOT NULL),
al AS (SELECT session_id, ts_ms, "case", CASE WHEN n >= 3 THEN 'dominance' ELSE 'uniqueness' END AS source, NULL AS hint FROM tr WHERE r = 1 AND (n >= 3 OR (c = 1 AND len <= 400))
 UNION ALL SELECT session_id, ts_ms, regexp_extract(name, '^\D+?\s+({ID})$', 1), 'click', regexp_extract(name, '^(\D+?)\s+{ID}$', 1) FROM nm WHERE regexp_matches(name, '^\D+?\s+{ID}$')
 UNION ALL SELECT session_id, ts_ms, unnest(list_distinct(regexp_extract_all(name, '\b{ID}\b'))), 'click', NULL FROM nm WHERE NOT regexp_matches(name, '^\D+?\s+{ID}$')),
an AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY session_id, ts_ms, "case" ORDER BY source = 'click', source, hint) = 1)"""


def anchors(spark, sf_dir) -> DataFrame:
    """Cases seen: those of texts by dominance or uniqueness, then those of clicked elements, each once a moment."""
    t = _texts(spark, sf_dir).withColumn("at", F.struct("event_id", "session_id", "ts_ms"))
    seen = U.dominant_ids(t, "at", case_ids(F.col("text")), F.length("text"), 3, 400)
    seen = seen.select("at.session_id", "at.ts_ms", F.col("case_id").alias("case"), "source", F.lit(None).cast("string").alias("hint"))
    return L.first_by_source(seen.unionByName(L.click_anchors(log(spark, sf_dir))))


@query(f"{_L}, {_ANCHORS} SELECT * FROM an")
def case_anchors(spark, sf_dir):
    return anchors(spark, sf_dir)


@query(f"""{_L}, r AS (SELECT session_id, event_id, ts_ms, trim(el_name) AS name, lag(trim(el_name)) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS before FROM l WHERE event_type = 'mouse_click' AND el_type = 'DataItem' AND trim(el_name) <> '')
SELECT session_id, event_id, name FROM r WHERE before IS NULL OR before <> name""")
def merged_row_clicks(spark, sf_dir):
    """Clicks on list items, of consecutive ones on the same item the first."""
    name = L.strip(F.col("el_name"))
    d = log(spark, sf_dir).where((F.col("event_type") == "mouse_click") & (F.col("el_type") == "DataItem")).select("session_id", "event_id", "ts_ms", name.alias("name")).where("name <> ''")
    before = F.lag("name").over(Window.partitionBy("session_id").orderBy("ts_ms", "event_id"))
    return d.withColumn("_b", before).where("_b is null or _b <> name").select("session_id", "event_id", "name")


@query(f"{_L} SELECT event_id, session_id FROM tx WHERE length(text) < 200 AND regexp_matches(text, ' done$')")
def completion_memos(spark, sf_dir):
    """Short texts that report a completed case."""
    return _texts(spark, sf_dir).where((F.length("text") < 200) & F.col("text").rlike(f" done$|{L.MEMO}")).select("event_id", "session_id")


@query(rf"""{_L}, c AS (SELECT session_id, unnest(regexp_extract_all(text, '\b{ID}\b')) AS "case" FROM tx UNION SELECT session_id, unnest(regexp_extract_all(el_name, '\b{ID}\b')) FROM l WHERE event_type = 'mouse_click')
SELECT c.session_id, "case", count(*) AS n FROM c JOIN tx ON tx.session_id = c.session_id AND contains(text, "case") GROUP BY 1, 2""")
def case_containment(spark, sf_dir):
    """How many texts of a session hold each of its cases (from texts and clicks, a distinct union) as a substring."""
    texts = _texts(spark, sf_dir)
    ids = lambda df, c: df.select("session_id", F.explode(case_ids(F.col(c))).alias("case"))
    cases = ids(texts, "text").union(ids(log(spark, sf_dir).where("event_type = 'mouse_click'"), "el_name")).distinct()
    hits = cases.join(texts.select("session_id", "text"), "session_id").where(F.contains("text", F.col("case")))
    return hits.groupBy("session_id", "case").agg(F.count("*").alias("n"))


_FILL = "last_value({v} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = "first_value({v} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_BOTH = lambda v: f"coalesce({_FILL.format(v=v)}, {_NEXT.format(v=v)})"
_NAMED = "(SELECT min(system) FROM sy WHERE contains({}, system))"
_STATES = f"""{_SYSTEMS}, {_NOTES}, sr AS (SELECT session_id, ts_ms, event_id, CASE WHEN system IS NULL THEN NULL ELSE 'sys_' || substr(sha1(system), 1, 4) END AS s, CASE WHEN route <> 'home' THEN route END AS r, p FROM (
 SELECT rt.*, coalesce({_NAMED.format('title')}, {_NAMED.format('tab_title')}) AS system, coalesce((SELECT min(ph.route) FROM ph WHERE ph.text = trim(el_name)), (SELECT min_by(ph.route, ph.text) FROM ph WHERE contains(trim(el_name), ph.text))) AS p FROM rt)),
st AS (SELECT session_id, ts_ms, event_id, {_BOTH('s')} AS system, coalesce({_BOTH('r')}, {_BOTH('p')}) AS route FROM sr)"""


def states(spark, sf_dir) -> DataFrame:
    """``session_id, ts_ms, event_id, system, route`` of every event, filled over its session: the url gives the route,
    and on-screen texts only where no url of the session does.  Texts meet the vocabularies in joins, each distinct one
    once; sources hold ``home`` as no route."""
    flat = log(spark, sf_dir)
    notes = S.keep(placeholders(flat).select("text", F.col("route").alias("by_note")), "notes")
    titles = flat.select(F.explode(F.array("title", "tab_title")).alias("text"))
    named = L.first_matches(titles, systems(flat).select(F.col("system").alias("fragment"))).select("text", L.slug(F.col("fragment")).alias("slug"))
    shown = flat.select(L.strip(F.col("el_name")).alias("text"))
    noted = L.first_matches(shown, notes.select(F.col("text").alias("fragment"))).join(notes.withColumnRenamed("text", "fragment"), "fragment").select("text", "by_note")
    route = url_route(F.col("url"))
    d = flat.select("session_id", "ts_ms", "event_id", "title", "tab_title", L.strip(F.col("el_name")).alias("shown"), F.when(route != "home", route).alias("by_url"))
    for column, found, name in (("title", named, "s1"), ("tab_title", named, "s2"), ("shown", notes, "n1"), ("shown", noted, "n2")):
        d = d.join(found.toDF("_text", name), F.col(column) == F.col("_text"), "left").drop("_text")
    d = d.select("session_id", "ts_ms", "event_id", F.coalesce("s1", "s2").alias("system"), "by_url", F.coalesce("n1", "n2").alias("by_text"))
    large = large_sessions(spark, sf_dir)
    d = d if large is None else S.keep(d, "states")  # cut sessions read it twice
    d = L.filled(d, ["session_id"], [F.col("ts_ms"), F.col("event_id")], ["system", "by_url", "by_text"], DAY_MS, large)
    return d.select("session_id", "ts_ms", "event_id", "system", F.coalesce("by_url", "by_text").alias("route"))


@query(f"{_L}, {_STATES} SELECT session_id, event_id, system, route FROM st")
def context_states(spark, sf_dir):
    return states(spark, sf_dir).select("session_id", "event_id", "system", "route")


_LABELS = f"""lb2 AS (SELECT um.session_id, start_ts, end_ts, coalesce(system, 'unknown') || '__' || coalesce(route, 'unknown') AS label FROM um JOIN st ON st.session_id = um.session_id AND st.ts_ms <= um.end_ts
 QUALIFY row_number() OVER (PARTITION BY um.session_id, start_ts, end_ts ORDER BY st.ts_ms DESC, st.event_id DESC) = 1)"""


def labelled(spark, sf_dir) -> DataFrame:
    """Units with the label ``system__route`` of the state at their end."""
    s = states(spark, sf_dir).withColumn("label", F.concat_ws("__", F.coalesce("system", F.lit("unknown")), F.coalesce("route", F.lit("unknown"))))
    return L.state_at(units_ms(spark, sf_dir), s, "session_id", "end_ts", ["ts_ms", "event_id"], "label", DAY_MS, large_sessions(spark, sf_dir))


@query(f"{_LU}, {_STATES}, {_LABELS} SELECT * FROM lb2")
def segment_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("session_id", "start_ts", "end_ts", "label")


_DOC = r"nullif(trim(regexp_extract(title, '^(.*?)\s+(?:-|\[)\s*Compatibility Mode', 1)), '')"
_DOCS = f"""{_STATES}, {_LABELS}, dt AS (SELECT session_id, ts_ms, {_DOC} AS doc FROM l WHERE title IS NOT NULL), dc AS (SELECT lb2.session_id, start_ts, end_ts, label, doc, count(*) AS n FROM lb2 JOIN dt ON dt.session_id = lb2.session_id AND ts_ms BETWEEN start_ts AND end_ts WHERE doc IS NOT NULL GROUP BY ALL),
dm AS (SELECT label, doc FROM dc QUALIFY row_number() OVER (PARTITION BY session_id, start_ts, end_ts ORDER BY n DESC, doc) = 1),
dl AS (SELECT label, doc, count(*) AS n FROM dm GROUP BY 1, 2), dp AS (SELECT label, doc AS top, CAST(sum(n) OVER (PARTITION BY label) AS BIGINT) AS n, n AS k, row_number() OVER (PARTITION BY label ORDER BY n DESC, doc) AS r FROM dl)"""


def documents_of(spark, sf_dir) -> DataFrame:
    """Units with a document in their titles: ``label, doc``, the one shown most often (the smaller on a tie)."""
    shown = log(spark, sf_dir).select("session_id", "ts_ms", L.document_title(F.col("title")).alias("doc")).where("doc is not null")
    inside = I.containment(labelled(spark, sf_dir), shown, "session_id", "ts_ms", DAY_MS, "inner")
    n = inside.groupBy("session_id", "start_ts", "end_ts", "label", "doc").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("v"), "doc")).alias("b")
    return n.groupBy("session_id", "start_ts", "end_ts", "label").agg(best).select("session_id", "start_ts", "end_ts", "label", F.col("b.doc").alias("doc"))


@query(f"{_LU}, {_DOCS}, tot AS (SELECT label, count(*) AS units FROM lb2 GROUP BY 1) SELECT label, units, coalesce(n, 0) AS n, top, round(100.0 * coalesce(n, 0) / units, 4) AS doc_rate, round(100.0 * k / n, 4) AS purity FROM tot LEFT JOIN (SELECT * FROM dp WHERE r = 1) USING (label)")
def doc_evidence(spark, sf_dir):
    """Per label the share of units with a document open, the dominant document and its share."""
    top = U.purity(documents_of(spark, sf_dir), "label", "doc")
    units = labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("units"))
    n = F.coalesce("total", F.lit(0))
    return units.join(top, "label", "left").select("label", "units", n.alias("n"), "top", F.round(100.0 * n / F.col("units"), 4).alias("doc_rate"), F.round(100 * F.col("share"), 4).alias("purity"))


@query(f"{_LU}, {_DOCS} SELECT round(100.0 * sum(k) / sum(n), 4) AS weighted_purity FROM dp WHERE r = 1")
def weighted_purity(spark, sf_dir):
    top = U.purity(documents_of(spark, sf_dir), "label", "doc")
    return top.agg(F.round(100.0 * F.sum("votes") / F.sum("total"), 4).alias("weighted_purity"))


@query(r"""{L}, q AS (SELECT tx.session_id, regexp_extract(text, '(Operator\d+) Manager', 1) AS name, regexp_extract(text, 'screen-\d+', 0) AS system, machine FROM tx JOIN l USING (event_id) WHERE regexp_matches(text, 'Operator\d+ Manager')),
c AS (SELECT name, system, count(*) AS n FROM q GROUP BY 1, 2), h AS (SELECT name, system AS home, n, sum(n) OVER (PARTITION BY name) AS tot, row_number() OVER (PARTITION BY name ORDER BY n DESC, system) AS r FROM c)
SELECT q.name, count(DISTINCT q.session_id) AS sessions, count(DISTINCT machine) AS machines, any_value(home) AS home, round(100.0 * any_value(n) / any_value(tot), 4) AS home_share FROM q JOIN h ON h.name = q.name AND r = 1 GROUP BY 1""".replace("{L}", _L))
def logins(spark, sf_dir):
    """Names that screens print as logged in: their sessions and machines, and the system where they mostly appear."""
    t = _texts(spark, sf_dir).join(log(spark, sf_dir).select("event_id", "machine"), "event_id")
    name = F.coalesce(F.nullif(F.regexp_extract("text", r"(Operator\d+) Manager", 1), F.lit("")), F.nullif(F.regexp_extract("text", L.LOGIN, 1), F.lit("")))
    q = t.select("session_id", "machine", name.alias("name"), F.regexp_extract("text", r"screen-\d+", 0).alias("system")).where("name is not null")
    home = U.purity(q, "name", "system").select("name", F.col("top").alias("home"), F.round(100 * F.col("share"), 4).alias("home_share"))
    return q.groupBy("name").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("machine").alias("machines")).join(home, "name")


@query(f"""{_LU}, bc AS (SELECT session_id, ts_ms, event_id, regexp_extract(text, 'Main / ([^\\n/]+) /', 1) AS crumb FROM tx)
SELECT um.session_id, start_ts, end_ts, (SELECT max_by(crumb, (ts_ms, event_id)) FROM bc WHERE bc.session_id = um.session_id AND ts_ms <= start_ts) AS in_force,
(SELECT max_by(crumb, (ts_ms, event_id)) FROM bc WHERE bc.session_id = um.session_id AND ts_ms BETWEEN start_ts AND end_ts) AS fresh,
coalesce((SELECT min_by(crumb, (ts_ms, event_id)) FROM bc WHERE bc.session_id = um.session_id AND ts_ms >= end_ts), (SELECT max_by(crumb, (ts_ms, event_id)) FROM bc WHERE bc.session_id = um.session_id)) AS next_or_last FROM um""")
def breadcrumbs(spark, sf_dir):
    """The breadcrumb in force as a unit begins, the last one captured inside it, and the first one from its end on (the
    session's last if none follows)."""
    crumb = F.coalesce(F.nullif(F.regexp_extract("text", L.BREADCRUMB, 1), F.lit("")), F.regexp_extract("text", r"Main / ([^\n/]+) /", 1))
    bc = _texts(spark, sf_dir).select("session_id", F.col("ts_ms").alias("at"), F.struct("event_id", crumb.alias("crumb")).alias("value"))
    from .operators.grid import asof

    u = asof(units_ms(spark, sf_dir), "session_id", "start_ts", bc, "at", "value", DAY_MS).withColumnRenamed("before", "b0").drop("after")
    u = asof(u, "session_id", "end_ts", bc, "at", "value", DAY_MS)
    last = bc.groupBy("session_id").agg(F.max(F.struct("at", "value")).alias("l"))
    u = u.join(last, "session_id", "left")
    fresh = F.when(F.col("before.at") >= F.col("start_ts"), F.col("before.value.crumb"))
    return u.select("session_id", "start_ts", "end_ts", F.col("b0.value.crumb").alias("in_force"), fresh.alias("fresh"), F.coalesce("after.value.crumb", "l.value.crumb").alias("next_or_last"))


@query(f"""{_L} SELECT ds, count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT "user") AS users, count(DISTINCT machine) AS machines,
string_agg(DISTINCT substr(strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d'), 1, 10), ',' ORDER BY substr(strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d'), 1, 10)) AS days FROM l GROUP BY 1""")
def scale_summary(spark, sf_dir):
    day = F.substring(F.timestamp_millis("ts_ms").cast("string"), 1, 10)
    return log(spark, sf_dir).groupBy("ds").agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("user").alias("users"), F.count_distinct("machine").alias("machines"),
        F.array_join(F.sort_array(F.collect_set(day)), ",").alias("days"),
    )


_SCREEN = f"""{_DOCS}, sc AS (SELECT split_part(label, '__', 2) AS screen, label, lb2.end_ts - lb2.start_ts AS spent, dm2.doc IS NOT NULL AS d FROM lb2 LEFT JOIN (SELECT DISTINCT session_id, start_ts, end_ts, 1 AS doc FROM dc) dm2 USING (session_id, start_ts, end_ts)),
sg AS (SELECT screen, count(*) AS n, CAST(sum(spent) AS BIGINT) AS spent, count(DISTINCT label) AS systems, count(*) FILTER (d) AS doc_runs FROM sc GROUP BY 1)"""


def screens(spark, sf_dir) -> DataFrame:
    docs = documents_of(spark, sf_dir).select("session_id", "start_ts", "end_ts", F.lit(True).alias("d"))
    u = labelled(spark, sf_dir).join(docs, ["session_id", "start_ts", "end_ts"], "left").withColumn("screen", F.get(F.split("label", "__"), F.lit(1)))
    return u.groupBy("screen").agg(F.count("*").alias("n"), F.sum(F.col("end_ts") - F.col("start_ts")).alias("spent"), F.count_distinct("label").alias("systems"), F.count("d").alias("doc_runs"))


@query(f"{_LU}, {_SCREEN} SELECT screen, n, spent, systems, round(100.0 * doc_runs / n, 4) AS judgment, round(100.0 * spent / sum(spent) OVER (), 4) AS share FROM sg")
def screen_judgment(spark, sf_dir):
    """Processes by screen; judgment is the share of its runs with a document open, so it is weighted by runs."""
    everything = Window.partitionBy()  # one row a screen
    return screens(spark, sf_dir).select("screen", "n", "spent", "systems", F.round(100.0 * F.col("doc_runs") / F.col("n"), 4).alias("judgment"), F.round(100.0 * F.col("spent") / F.sum("spent").over(everything), 4).alias("share"))


_RANKED = f"""{_STATES}, {_LABELS}, lp AS (SELECT label, count(*) AS n, CAST(sum(end_ts - start_ts) AS BIGINT) AS spent FROM lb2 GROUP BY 1), rk AS (SELECT *, split_part(label, '__', 2) AS screen, row_number() OVER (ORDER BY spent DESC, label) AS place FROM lp)"""


@query(f"{_LU}, {_RANKED}, f AS (SELECT min(place) AS stop FROM rk WHERE screen <> (SELECT screen FROM rk WHERE place = 1)) SELECT label, n, spent, place, place < coalesce((SELECT stop FROM f), 1000000) AS leading FROM rk")
def leading_run(spark, sf_dir):
    """Labels by time spent, and whether all from the top down to each belong to the top one's screen."""
    p = labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("end_ts") - F.col("start_ts")).alias("spent"))
    order = Window.orderBy(F.desc("spent"), "label")  # one row a label
    p = p.withColumn("screen", F.get(F.split("label", "__"), F.lit(1))).withColumn("place", F.row_number().over(order).cast("bigint"))
    top = F.first("screen").over(order)
    p = p.withColumn("other", (F.col("screen") != top).cast("int"))
    return p.withColumn("leading", F.max("other").over(order) == 0).select("label", "n", "spent", "place", "leading")
