"""Registered queries on worklists, regulations and reports: definitions, notes, routes, fixtures, updates, runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _A, _units, _units_sql, query
from . import desk
from .desk import log, scratch
from .functions import regulations as J
from .functions.text import LONGEST_PAYLOAD, RAW_FIELDS, ROW_ID, SESSION_ID, element_prefix, payload_refusal, yen
from .log_reports import _L
from .operators import audits as U
from .operators import learn as M
from .operators import report as T
from .operators.grid import asof
from .operators.rules import majority
from .streaming.confirmations import last_notes
from .sources.event_log import activity, table

#: Definitions of a worklist by kind of row: kind, mode, template of the note.
DEFINITIONS = [("1-URGENT", "review", "{ID} needs {kind}"), ("2-HIGH", "deterministic", "{ID}: {amount} checked"), ("default", "deterministic", "{ID} {unknown}")]


def _definitions(spark):
    """The definitions as JSON lines, written and read again."""
    path = scratch(spark, "definitions")
    spark.createDataFrame(DEFINITIONS, "route_value string, mode string, template string").write.json(path)
    return spark.read.schema("route_value string, mode string, template string").json(path)


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders)
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND amount >= 200000 THEN 'automated_by_rule' WHEN o_orderpriority = '1-URGENT' THEN 'queued_for_review' ELSE 'automated' END AS mode,
CASE WHEN o_orderpriority = '1-URGENT' THEN concat(o_orderkey, ' needs ', o_orderpriority) WHEN o_orderpriority = '2-HIGH' THEN concat(o_orderkey, ': ', amount, '円 checked') ELSE concat(o_orderkey, ' checked') END AS note FROM o""")
def worklist_notes(spark, sf_dir):
    """Rows by the definition of their kind (or the default one): the note from its template, and the mode; rows for
    review whose amount a rule covers are routed by it."""
    d = F.broadcast(_definitions(spark))  # a row a kind
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.floor("o_totalprice").cast("bigint").alias("a"))
    row = F.create_map(F.lit("ID"), F.col("o_orderkey").cast("string"), F.lit("kind"), F.col("kind"), F.lit("amount"), F.concat(F.col("a").cast("string"), F.lit("円")))
    own, other = d.where("route_value <> 'default'"), d.where("route_value = 'default'").select(F.col("mode").alias("m0"), F.col("template").alias("t0"))
    x = o.withColumn("row", row).join(own, F.col("kind") == F.col("route_value"), "left").crossJoin(F.broadcast(other))  # one row
    note = J.filled_template(F.coalesce("template", "t0"), F.col("row"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" checked")))
    rules = F.expr("array(named_struct('yen', 200000L, 'cmp', '以上', 'outcome', 'board'))")
    ruled = J.route_by(yen(F.col("row")["amount"]), rules).isNotNull()
    mode = F.when(F.coalesce("mode", "m0") != "review", "automated").when(ruled, "automated_by_rule").otherwise("queued_for_review")
    return x.select("o_orderkey", mode.alias("mode"), note.alias("note"))


@query("WITH n AS (SELECT * FROM (VALUES ('1-URGENT', 'urgent orders'), ('5-LOW', 'slow orders')) t(code, name)) SELECT o_orderpriority AS code, coalesce(max(name), o_orderpriority) AS name, count(*) AS n FROM orders LEFT JOIN n ON code = o_orderpriority GROUP BY o_orderpriority")
def process_names(spark, sf_dir):
    """Processes by name where one is known, else by code."""
    names = spark.createDataFrame([("1-URGENT", "urgent orders"), ("5-LOW", "slow orders")], "code string, name string")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(names), "code", "left").select("code", F.coalesce("name", "code").alias("name"), "n")  # a row a name


_MEASURES = """p AS (SELECT l_suppkey AS label, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (l_returnflag = 'R') AS transfers, count(*) FILTER (l_linestatus = 'O') AS judged FROM lineitem GROUP BY 1),
w AS (SELECT label, unnest(['total', 'runs', 'total x automatability', 'transfers', 'transfers x automatability']) AS weighting, unnest([CAST(total AS DOUBLE), CAST(n AS DOUBLE), total * greatest(0.05, 1 - judged / n), CAST(transfers AS DOUBLE), transfers * greatest(0.05, 1 - judged / n)]) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY weighting ORDER BY round(score, 4) DESC, label) AS place FROM w)"""


def _weighted(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("label")).agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("transfers"), F.count_if(F.col("l_linestatus") == "O").alias("judged")
    )
    free = F.greatest(F.lit(0.05), 1 - F.col("judged") / F.col("n"))
    scores = {"total": F.col("total"), "runs": F.col("n"), "total x automatability": F.col("total") * free, "transfers": F.col("transfers"), "transfers x automatability": F.col("transfers") * free}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("weighting"), v.cast("double").alias("score")) for k, v in scores.items()])).alias("x")
    long = p.select("label", rows).select("label", "x.*")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("weighting").orderBy(F.desc(F.round("score", 4)), "label")).cast("bigint"))


@query(f"WITH {_MEASURES} SELECT label, count(*) AS appearances FROM r WHERE place <= 3 GROUP BY 1")
def robustness_five(spark, sf_dir):
    """How often each label stands among the first three under five weightings."""
    return _weighted(spark, sf_dir).where("place <= 3").groupBy("label").agg(F.count("*").alias("appearances"))


@query(f"WITH {_MEASURES} SELECT label, round(score, 4) AS priority, place FROM r WHERE weighting = 'transfers x automatability' AND place <= 10")
def priority_order(spark, sf_dir):
    """The ten labels of the highest priority, with their places: a top-k report."""
    return _weighted(spark, sf_dir).where("weighting = 'transfers x automatability' and place <= 10").select("label", F.round("score", 4).alias("priority"), "place")


_REGULATION = "concat('R', k % 5, '規程 第1条 limit ', k, ' 附則 end。', chr(13), 'R', k % 3, '規程 第1条 other ', k % 7, '。')"


@query(f"""WITH {_A}, b AS (SELECT concat('R', k % 5, '規程') AS title, concat('R', k % 5, '規程 第1条 limit ', k, ' 附則 end。', chr(13)) AS body FROM a WHERE k % 5 <> k % 3 UNION ALL SELECT concat('R', k % 3, '規程'), concat('R', k % 3, '規程 第1条 other ', k % 7, '。') FROM a)
SELECT title, arg_max(body, (length(body), body)) AS body FROM b GROUP BY 1""")
def regulation_bodies(spark, sf_dir):
    """Regulations of screen captures by their printed titles, each with its longest body."""
    return J.corpus(activity(spark, sf_dir).select(F.expr(_REGULATION).alias("text")), "text")


@query(f"""WITH {_A}, m AS (SELECT session_id, event_id, k, 'limit ' || (k % 13) AS subject FROM a WHERE event_type = 'purchase')
SELECT session_id, event_id FROM m WHERE NOT contains(concat('R', k % 5, '規程 第1条 limit ', k, ' 附則'), subject)""")
def governed_audit(spark, sf_dir):
    """Rows routed by a rule whose regulation does not name their subject: the offenders of an audit."""
    m = activity(spark, sf_dir).where("event_type = 'purchase'").select("session_id", "event_id", F.expr(_REGULATION).alias("text"), F.expr("concat('limit ', k % 13)").alias("subject"))
    return m.where(J.ungoverned(F.lit("automated_by_rule"), F.col("text"), F.col("subject"))).select("session_id", "event_id")


@query(f"""WITH {_A}, d AS (SELECT DISTINCT concat('R', k % 9, '規程') AS title FROM a WHERE event_type = 'click'), s AS (SELECT concat('R', k % 5, '規程') AS title FROM a UNION SELECT concat('R', k % 3, '規程') FROM a) SELECT title FROM d WHERE title NOT IN (SELECT title FROM s)""")
def rules_without_source(spark, sf_dir):
    """Regulations that definitions refer to and no capture shows."""
    asked = activity(spark, sf_dir).where("event_type = 'click'").select(F.expr("concat('R', k % 9, '規程')").alias("title")).distinct()
    shown = J.corpus(activity(spark, sf_dir).select(F.expr(_REGULATION).alias("text")), "text")
    return asked.join(shown, "title", "left_anti")


@query(f"""WITH {_A}, t AS (SELECT event_id, k % 9 + 1 AS w, k * 1000 + 500 AS y FROM a), r AS (SELECT event_id, w * 10000 AS yen, '以上' AS cmp, 'board' || w AS outcome FROM t UNION ALL SELECT event_id, y, '超', '役員承認' FROM t)
SELECT event_id, CAST(yen AS BIGINT) AS yen, cmp, outcome FROM r""")
def rules_from_text(spark, sf_dir):
    """Threshold rules of regulation prose, tabulated and written out."""
    text = F.expr("concat(k % 9 + 1, '万円以上：board', k % 9 + 1, '。金額が', format_number(k * 1000 + 500, 0), '円を超える場合は役員の承認が必要。')")
    r = activity(spark, sf_dir).select("event_id", F.explode(J.threshold_rules(text)).alias("r"))
    return r.select("event_id", "r.yen", "r.cmp", "r.outcome")


@query(f"""WITH {_A} SELECT event_id, concat('P1-', session_id, '-', x) AS "ID", concat('name', k) AS name, CASE WHEN x = 1 THEN 'open' ELSE 'done' END AS state FROM a, (VALUES (1), (2)) v(x) WHERE event_type = 'view'""")
def captured_tables(spark, sf_dir):
    """The rows of worklists as screens print them: the header gives the columns, a row begins at an identifier."""
    text = F.expr("concat('top\\n申請一覧\\nID\\nname\\nstate\\nP1-', session_id, '-1\\nname', k, '\\nopen\\nnoise\\nP1-', session_id, '-2\\nname', k, '\\ndone\\n')")
    r = activity(spark, sf_dir).where("event_type = 'view'").select("event_id", F.explode(J.screen_rows(text)).alias("r"))
    return r.select("event_id", *[F.col("r")[c].alias(c) for c in ("ID", "name", "state")])


@query(f"""WITH {_A} SELECT event_id, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 = 1 END AS same FROM a WHERE event_type = 'error'""")
def drafted_agreement(spark, sf_dir):
    """Whether rules drafted as JSON are those of the captured regulation, cleaned; null where the reply is no list of rules."""
    # a capture: the regulation between a record that isn't part of it and what follows its end
    text = F.expr("concat('R', k % 5, '規程\r承認記録 9万円以上：別承認\r', k % 9 + 1, '万円未満：部門長承認\n', k % 9 + 1, '万円以上：役員承認\n附則 施行。\r外\n7万円以上：外承認')")
    draft = lambda yen: F.expr(f"""concat('[{{"yen": ', {yen}, ', "cmp": "以上", "outcome": "役員承認"}}, {{"yen": ', {yen}, ', "cmp": "未満", "outcome": "部門長承認"}}]')""")
    right, wrong = draft("(k % 9 + 1) * 10000"), draft("(k % 9 + 2) * 10000")
    turn = F.col("k") % 4
    reply = F.when(turn == 0, "no rules").when(turn == 1, F.concat(F.lit("```json\n"), right, F.lit("\n```"))).when(turn == 2, wrong).otherwise("[]")
    e = activity(spark, sf_dir).where("event_type = 'error'")
    return e.select("event_id", J.same_rules(J.drafted_rules(reply), J.threshold_rules(J.sanitised(text, ["承認記録"]))).alias("same"))


@query("""SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders""")
def yen_parse(spark, sf_dir):
    """Amounts out of text: digits with commas before the unit."""
    text = F.concat(F.lit("total "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" 円 due"))
    return table(spark, sf_dir, "orders").select("o_orderkey", yen(text).alias("amount"))


_STATES = "CASE k % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'open' WHEN 2 THEN 'held' ELSE 'done' END"


@query(f"""WITH {_A}, c AS (SELECT event_type AS screen, k AS row_id, {_STATES} AS state, t, event_id FROM a), f AS (SELECT screen, row_id, min_by(state, (t, event_id)) AS state, min((t, event_id)) AS first FROM c GROUP BY 1, 2),
s AS (SELECT screen, state, count(*) AS n, min(first) AS first FROM f GROUP BY 1, 2), p AS (SELECT screen, CAST(sum(n) AS BIGINT) AS n_rows, coalesce(min_by(state, first) FILTER (state IN ('open', 'held')), arg_min(state, (-n, first))) AS pending FROM s GROUP BY 1)
SELECT p.screen, n_rows, pending, coalesce((SELECT min_by(s.state, s.first) FROM s WHERE s.screen = p.screen AND s.state <> pending), 'done') AS done FROM p WHERE n_rows >= 5""")
def fixture_build(spark, sf_dir):
    """Worklists of captures: each row as it was first seen, and which state means pending and which done; kept as JSON."""
    c = activity(spark, sf_dir).select(F.col("event_type").alias("screen"), F.col("k").alias("row_id"), F.expr(_STATES).alias("state"), F.struct("t", "event_id").alias("at"))
    f = c.groupBy("screen", "row_id").agg(F.min_by("state", "at").alias("state"), F.min("at").alias("first"))
    s = f.groupBy("screen", "state").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    waits = F.col("state").isin("open", "held")
    pending = F.coalesce(F.min_by(F.when(waits, F.col("state")), F.when(waits, F.col("first"))), F.min_by("state", F.struct((-F.col("n")).alias("n"), "first")))
    p = s.groupBy("screen").agg(F.sum("n").alias("n_rows"), pending.alias("pending")).where("n_rows >= 5")
    done = s.join(p.select("screen", "pending"), "screen").where("state <> pending").groupBy("screen").agg(F.min_by("state", "first").alias("done"))
    path = scratch(spark, "fixture")
    p.join(done, "screen", "left").select("screen", "n_rows", "pending", F.coalesce("done", F.lit("done")).alias("done")).write.json(path)
    return spark.read.schema("screen string, n_rows bigint, pending string, done string").json(path)


@query(f"""{_L}, c AS (SELECT session_id, ts_ms, event_id, regexp_extract(text, 'Main / ([^\\n/]+) /', 1) AS crumb FROM tx), e AS (SELECT session_id, ts_ms, CASE WHEN starts_with(el_id, 'btn-') THEN split_part(el_id, '-', 2) ELSE split_part(el_id, '-', 1) END AS prefix FROM l WHERE el_id IS NOT NULL),
j AS (SELECT prefix, coalesce((SELECT min_by(crumb, (c.ts_ms, c.event_id)) FROM c WHERE c.session_id = e.session_id AND c.ts_ms >= e.ts_ms), (SELECT max_by(crumb, (c.ts_ms, c.event_id)) FROM c WHERE c.session_id = e.session_id)) AS screen FROM e),
v AS (SELECT screen, prefix, count(*) AS votes FROM j WHERE screen IS NOT NULL GROUP BY 1, 2) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY screen ORDER BY votes DESC, prefix) = 1 AND votes >= 1""")
def screen_prefix_majority(spark, sf_dir):
    """The prefix of element ids that goes with each screen, by the first breadcrumb captured after a click."""
    crumb = F.regexp_extract("text", r"Main / ([^\n/]+) /", 1)
    c = desk.texts(spark, sf_dir).select("session_id", F.col("ts_ms").alias("at"), F.struct("event_id", crumb.alias("crumb")).alias("value"))
    e = log(spark, sf_dir).where("el_id is not null").select("session_id", "ts_ms", element_prefix(F.col("el_id")).alias("prefix"))
    last = c.groupBy("session_id").agg(F.max(F.struct("at", "value")).alias("l"))
    j = asof(e, "session_id", "ts_ms", c, "at", "value").join(last, "session_id", "left")
    return majority(j.select("prefix", F.coalesce("after.value.crumb", "l.value.crumb").alias("screen")).where("screen is not null"), "screen", "prefix", 1)


_JUDGED = """j AS (SELECT l_suppkey % 40 AS screen, 100.0 * count(*) FILTER (l_linestatus = 'O') / count(*) AS judgment FROM lineitem WHERE l_suppkey % 40 < 30 GROUP BY 1)"""


@query(f"""WITH {_JUDGED}, r AS (SELECT l_suppkey % 40 AS screen, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS automated FROM lineitem GROUP BY 1)
SELECT CASE WHEN judgment IS NULL THEN 'unmeasured' WHEN judgment > 50 THEN 'most runs' ELSE 'others' END AS kind, count(*) AS screens, CAST(sum(automated) AS BIGINT) AS automated, CAST(sum(n) AS BIGINT) AS n FROM r LEFT JOIN j USING (screen) GROUP BY 1""")
def automation_by_judgment(spark, sf_dir):
    """Automated rows on screens whose operators consult a document in most runs, on the others, and on those not measured."""
    lines = table(spark, sf_dir, "lineitem").withColumn("screen", F.col("l_suppkey") % 40)
    measured = lines.where("screen < 30").groupBy("screen").agg((100.0 * F.count_if(F.col("l_linestatus") == "O") / F.count("*")).alias("judgment"))
    r = lines.groupBy("screen").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("automated"))
    kind = F.when(F.col("judgment").isNull(), "unmeasured").when(F.col("judgment") > 50, "most runs").otherwise("others")
    return r.join(measured, "screen", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("screens"), F.sum("automated").alias("automated"), F.sum("n").alias("n"))


@query(f"""WITH {_A}, u AS (SELECT k AS row_id, max_by('note ' || event_id, (t, event_id)) AS note FROM a WHERE event_type = 'purchase' GROUP BY 1)
SELECT o_orderkey, CASE WHEN note IS NOT NULL THEN 'F' ELSE o_orderstatus END AS status, note FROM orders LEFT JOIN u ON row_id = o_orderkey""")
def confirm_updates(spark, sf_dir):
    """A worklist after confirmations: the last one of each row sets it done with its note (``streaming.confirmations``
    takes them as a stream whose replay changes nothing)."""
    note = F.concat(F.lit("note "), F.col("event_id").cast("string"))
    u = last_notes(activity(spark, sf_dir).where("event_type = 'purchase'").select(F.col("k").cast("bigint").alias("row_id"), "t", "event_id", note.alias("note")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return rows.join(u, F.col("o_orderkey") == F.col("row_id"), "left").select("o_orderkey", F.when(F.col("note").isNotNull(), "F").otherwise(F.col("status")).alias("status"), "note")


@query("""SELECT o_orderpriority AS screen, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P",
list_sort(list(CAST(floor(o_totalprice) AS BIGINT)))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50, quantile_disc(CAST(floor(o_totalprice) AS BIGINT), 0.95) AS nearest_p95 FROM orders GROUP BY 1""")
def run_modes(spark, sf_dir):
    """Outcomes of a run by screen (a pivot), with the list-index median and the nearest-rank 95 % point."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("screen"), "o_orderstatus", F.floor("o_totalprice").alias("v"))
    counts = o.groupBy("screen").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    disc = o.groupBy("screen").agg(F.expr("percentile_disc(0.95) within group (order by v)").cast("bigint").alias("nearest_p95"))
    return counts.join(U.indexed_quantiles(o, "screen", "v", {"p50": 0.5}).drop("n"), "screen").join(disc, "screen")


@query("""WITH p AS (SELECT o_orderpriority AS label, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY 1), l AS (SELECT 2 + row_number() OVER (ORDER BY total DESC, label) AS line, concat('| ', label, ' | ', n, ' | ', total, ' |') AS text FROM p)
SELECT CAST(line AS BIGINT) AS line, text FROM l UNION ALL SELECT 1, '| process | runs | total |' UNION ALL SELECT 2, '|---|---|---|'""")
def report_lines(spark, sf_dir):
    """A report table in Markdown, written as text lines and the run as JSON; the lines are read again from there."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice").cast("bigint")).alias("total"))
    run = scratch(spark, "run")
    p.write.json(run)
    p = spark.read.schema("label string, n bigint, total bigint").json(run)
    line = (F.row_number().over(Window.orderBy(F.desc("total"), "label")) + 2).cast("bigint")  # one row a label
    rows = p.select(line.alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", "label", "n", "total"), F.lit(" |")).alias("text"))
    head = spark.createDataFrame([(1, "| process | runs | total |"), (2, "|---|---|---|")], "line bigint, text string")
    path = scratch(spark, "report")
    head.unionByName(rows).select(F.concat_ws("\t", "line", "text").alias("value")).write.text(path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].cast("bigint").alias("line"), parts[1].alias("text"))


@query()
def event_tags(spark, sf_dir):
    """Kinds of events (openings, closes, others) told from the time around them, by a model of half of the sessions for
    the other half; a model has no SQL, a test checks its accuracy on separable rows."""
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    d = activity(spark, sf_dir).withColumns({"gap": F.log1p(F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0)).cast("double")), "next": F.log1p(F.coalesce(F.lead("t").over(w) - F.col("t"), F.lit(0)).cast("double")), "kd": F.col("k").cast("double")})
    d = d.withColumn("tag", F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "purchase", "close").otherwise("other"))
    model = M.tagger(d.where("session_id % 2 = 0"), "tag", ["gap", "next", "kd"], trees=10)
    return model.transform(d.where("session_id % 2 = 1")).select("session_id", "event_id", "tag", F.col("prediction"))


__all__ = ["DEFINITIONS"]


_PAYLOAD = """CASE WHEN k % 9 = 0 THEN concat('{"event_id": "e', e, '", "text": "INV-10-', k, '"}') WHEN k % 9 = 1 THEN concat('seen in ses_', 20240000 + u, '-', 100000 + k) WHEN k % 9 = 2 THEN concat('row INV', k % 10, '-', 10 + u % 5, '-', k, ' is open')
 WHEN k % 9 = 3 THEN concat('machine_id of ', kind) WHEN k % 9 = 4 THEN repeat(concat(kind, ' ', k, ' '), 3000) WHEN k % 9 = 5 THEN concat('{"machine_id": ', u, '}') ELSE concat('screen of ', kind, ' INV-1-', k) END"""
_REFUSED = f"CASE WHEN length(p) > {LONGEST_PAYLOAD} THEN 'too long' " + " ".join(f"WHEN contains(p, '\"{f}\"') THEN 'raw field {f}'" for f in RAW_FIELDS)


@query(f"""WITH {desk._BASE}, x AS (SELECT e AS event_id, {_PAYLOAD} AS p FROM lb) SELECT event_id, {_REFUSED} WHEN regexp_matches(p, '{SESSION_ID}') OR regexp_matches(p, '{ROW_ID}') THEN 'identifier' END AS reason FROM x""")
def payload_refusals(spark, sf_dir):
    """Which payloads made from the log may not leave, and why: bulk, raw records, identifiers in plain text."""
    return desk._events(spark, sf_dir).select(F.col("e").alias("event_id"), payload_refusal(F.expr(_PAYLOAD)).alias("reason"))


_TENTHS = "coalesce(concat(CAST(floor(floor(1000 * {0} / nullif({1}, 0)) / 10) AS BIGINT), '.', CAST(floor(1000 * {0} / nullif({1}, 0)) AS BIGINT) % 10, '%'), '-')"


@query(f"""WITH {_MEASURES}, z AS (SELECT count(*) AS labels, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total, CAST(sum(judged) AS BIGINT) AS judged FROM p),
k AS (SELECT place, p.* FROM r JOIN p USING (label) WHERE weighting = 'transfers x automatability' AND place <= 10), b AS (SELECT label, count(*) AS c FROM r WHERE place <= 3 GROUP BY 1),
g AS (SELECT label % 40 AS screen, count(*) AS labels, CAST(sum(n) AS BIGINT) AS n, CAST(sum(judged) AS BIGINT) AS judged FROM p GROUP BY 1), bn AS (SELECT *, 2 + row_number() OVER (ORDER BY c DESC, label) AS line FROM b), gn AS (SELECT *, 2 + row_number() OVER (ORDER BY n DESC, screen) AS line FROM g)
SELECT CAST(section AS INTEGER) AS section, CAST(line AS BIGINT) AS line, text FROM (VALUES (1, -1, '## Scale'), (2, -1, '## Ranking'), (2, 1, '| place | label | runs | share | judged |'), (2, 2, '|---|---|---|---|---|'), (3, -1, '## Robustness'), (3, 1, '| label | weightings |'), (3, 2, '|---|---|'), (4, -1, '## Screens'), (4, 1, '| screen | labels | runs | share | judged |'), (4, 2, '|---|---|---|---|---|')) AS h(section, line, text)
UNION ALL SELECT 1, 0, concat(n, ' runs of ', labels, ' labels, ', total, ' units of work, ', {_TENTHS.format('judged', 'n')}, ' of the runs judged.') FROM z
UNION ALL SELECT 2, 2 + place, concat('| ', place, ' | ', label, ' | ', k.n, ' | ', {_TENTHS.format('k.n', 'z.n')}, ' | ', {_TENTHS.format('k.judged', 'k.n')}, ' |') FROM k, z
UNION ALL SELECT 3, 0, concat(count(*) FILTER (c = 5), ' of ', count(*), ' labels are among the first three under all weightings.') FROM b
UNION ALL SELECT 3, line, concat('| ', label, ' | ', c, ' of 5 |') FROM bn
UNION ALL SELECT 4, 0, concat('Screen ', arg_max(screen, (n, -screen)), ' has the most runs: ', max(n), '.') FROM g
UNION ALL SELECT 4, line, concat('| ', screen, ' | ', gn.labels, ' | ', gn.n, ' | ', {_TENTHS.format('gn.n', 'z.n')}, ' | ', {_TENTHS.format('gn.judged', 'gn.n')}, ' |') FROM gn, z""")
def process_report(spark, sf_dir):
    """The report on processes: scale, ranking by priority (ten), robustness under five weightings, and the 40 screens."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("label")).agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("total"), F.count_if(F.col("l_linestatus") == "O").alias("judged")
    )
    z = p.agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("judged").alias("judged"))
    all_runs = F.broadcast(z.select(F.col("n").alias("all")))  # one row
    top, often = priority_order(spark, sf_dir).join(p, "label").crossJoin(all_runs), robustness_five(spark, sf_dir)
    g = p.groupBy(F.pmod("label", F.lit(40)).alias("screen")).agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("judged").alias("judged"))
    n, judged = F.col("n"), F.col("judged")
    shares = {"runs": n, "share": T.share(n, F.col("all")), "judged": T.share(judged, n)}
    words = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    first = g.agg(F.max_by("screen", F.struct("n", (-F.col("screen")).alias("s"))).alias("screen"), F.max("n").alias("n"))
    survivors = often.agg(F.count_if(F.col("appearances") == 5).alias("k"), F.count("*").alias("n"))
    return T.written(spark, scratch(spark, "report"), {
        "Scale": [T.sentence(z, words(n, " runs of ", F.col("labels"), " labels, ", F.col("total"), " units of work, ", T.share(judged, n), " of the runs judged."))],
        "Ranking": [T.table_lines(top, {"place": F.col("place"), "label": F.col("label"), **shares}, [F.col("place")])],
        "Robustness": [
            T.sentence(survivors, words(F.col("k"), " of ", n, " labels are among the first three under all weightings.")),
            T.table_lines(often, {"label": F.col("label"), "weightings": words(F.col("appearances"), " of 5")}, [F.desc("appearances"), F.col("label")]),
        ],
        "Screens": [
            T.sentence(first, words("Screen ", F.col("screen"), " has the most runs: ", n, ".")),
            T.table_lines(g.crossJoin(all_runs), {"screen": F.col("screen"), "labels": F.col("labels"), **shares}, [F.desc("n"), F.col("screen")]),
        ],
    })
