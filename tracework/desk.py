"""The driver's ``events`` in the shape of a desktop log, for the operators that need one; and the same in SQL.

Views are clicks on table cells and purchases clicks on buttons of a web screen, clicks are clicks on list
items, signups are switches of the application, errors are keystrokes in a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.event_log import LOG_SCHEMA, scratch, table

#: The flat columns that the queries use, as SQL expressions of an event (k: its number, u: its user, t: microseconds).
FLAT = {
    "ds": "concat('d', u % 2)",
    "session_id": "concat('ses_', u)",
    "chunk_id": "concat('chunk_', e % 3)",
    "seq": "CASE WHEN k % 11 <> 0 THEN e END",
    "event_id": "concat('e', e)",
    "ts_ms": "{ms}",
    "event_type": "CASE kind WHEN 'view' THEN 'browser_click' WHEN 'purchase' THEN 'browser_click' WHEN 'click' THEN 'mouse_click' WHEN 'signup' THEN 'app_switch' ELSE 'keystroke' END",
    "layer": "CASE WHEN kind IN ('view', 'purchase') THEN 'L3' ELSE 'L2' END",
    "gap_ms": "CAST(k AS BIGINT)",
    "machine": "concat('m', u % 7)",
    "user": "concat('h', u)",
    "app": "CASE WHEN kind IN ('view', 'purchase') THEN 'Google Chrome' WHEN kind = 'error' THEN 'Writer' ELSE 'Desk' END",
    "proc": "CASE WHEN kind IN ('view', 'purchase') THEN 'chrome' ELSE 'desk' END",
    "title": "CASE WHEN kind IN ('view', 'purchase') THEN concat('System ', u % 3, CASE WHEN k % 4 = 0 THEN ' and 2 more pages' ELSE '' END, ' - Profile 1 - Browser') WHEN kind = 'error' AND k % 3 <> 0 THEN concat('Rules ', (u + k) % 5, ' - Compatibility Mode - Writer') END",
    "url": "CASE WHEN kind IN ('view', 'purchase') THEN CASE WHEN k % 6 <> 0 OR kind = 'purchase' THEN concat('https://app.test/#/screen-', k % 4) ELSE 'https://app.test/#/home' END END",
    "tab_title": "CASE WHEN kind IN ('view', 'purchase') THEN concat('Tab ', k % 2) END",
    "has_text": "k % 5 = 0",
    "key": "CASE WHEN kind = 'error' THEN 'Enter' END",
    "char": "CASE WHEN kind = 'error' THEN 'x' END",
    "mods": "CASE WHEN kind = 'error' THEN nullif(concat(CASE WHEN k % 2 = 0 THEN 'ctrl' ELSE '' END, CASE WHEN k % 6 = 0 THEN '+' ELSE '' END, CASE WHEN k % 3 = 0 THEN 'shift' ELSE '' END), '') END",
    "el_name": "CASE WHEN kind IN ('view', 'purchase') THEN CASE WHEN k % 2 = 0 THEN concat('note of ', k % 4) ELSE concat('row ', k % 9) END WHEN kind = 'click' THEN CASE WHEN k % 3 = 0 THEN concat('  Payroll INV-', 10 + u % 5, '-', k, ' ') ELSE concat('Item ', k % 8, ' of INV-', 10 + u % 5, '-', k) END WHEN kind = 'error' THEN 'body' END",
    "el_type": "CASE WHEN kind = 'click' THEN 'DataItem' WHEN kind = 'error' THEN 'Edit' END",
    "el_value": "CASE WHEN kind = 'click' THEN CAST(k AS STRING) END",
    "hint": "CASE WHEN kind = 'signup' THEN 'taskbar' END",
    "el_id": "CASE WHEN kind = 'view' THEN concat('s', k % 4, '-cell') WHEN kind = 'purchase' AND k % 8 <> 0 THEN concat('btn-s', k % 4, '-ok') WHEN kind = 'purchase' THEN 'save' END",
    "el_class": "CASE WHEN kind IN ('view', 'purchase') THEN 'c' END",
    "el_tag": "CASE WHEN kind = 'view' THEN 'td' WHEN kind = 'purchase' THEN 'button' END",
    "el_sel": "CASE WHEN kind IN ('view', 'purchase') THEN concat('#r', k) END",
    "prev_url": "CAST(NULL AS STRING)",
    "new_app": "CASE WHEN kind = 'signup' THEN concat('App', k % 4) END",
    "prev_app": "CASE WHEN kind = 'signup' THEN 'Desk' END",
    "new_title": "CASE WHEN kind = 'signup' THEN concat('Window ', k % 3) END",
    "prev_title": "CAST(NULL AS STRING)",
    "clip_len": "CAST(NULL AS BIGINT)",
    "shot": "CAST(NULL AS STRING)",
}

_TEXT = "CASE WHEN k % 5 = 0 THEN concat('Main / screen-', k % 4, ' / INV-', 10 + u % 5, '-', k, CASE WHEN k % 10 = 0 THEN concat(' INV-', 10 + u % 5, '-', k, ' INV-', 10 + u % 5, '-', k) ELSE '' END, CASE WHEN k % 15 = 0 THEN concat(' Operator', u % 4, ' Manager') ELSE '' END, CASE WHEN k % 20 = 0 THEN ' done' ELSE ' open' END) ELSE '' END"

_BASE = "lb AS (SELECT user_id AS u, event_id AS e, epoch_us(ts) AS t, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def _duck(expression: str) -> str:
    return expression.format(ms="t // 1000").replace("AS STRING", "AS VARCHAR")


#: The flat log ``l`` and the text table ``tx`` in SQL.
LOG_SQL = f"""{_BASE}, l AS (SELECT {', '.join(f'{_duck(v)} AS "{k}"' for k, v in FLAT.items())} FROM lb),
tx AS (SELECT concat('e', e) AS event_id, concat('ses_', u) AS session_id, t // 1000 AS ts_ms, {_TEXT} AS text, concat('d', u % 2) AS ds FROM lb WHERE k % 5 = 0)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("u"), F.col("event_id").alias("e"), t.alias("t"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested events, with ``ds`` and ``chunk`` for their folders."""
    x = {k: v.format(ms="t div 1000") for k, v in FLAT.items()}
    web, item, note, app = ("kind IN ('view', 'purchase')", "kind = 'click'", "kind = 'error'", "kind = 'signup'")
    where = lambda holds, value: f"CASE WHEN {holds} THEN {value} END"
    payload = {
        "key": x["key"], "character": x["char"], "keys": "CAST(NULL AS ARRAY<STRING>)",
        "modifiers": where(note, "map('ctrl', k % 2 = 0, 'shift', k % 3 = 0)"), "action_hint": "CAST(NULL AS STRING)",
        "target_field": where(note, "named_struct('name', 'body', 'control_type', 'Edit', 'value', CAST(NULL AS STRING))"),
        "target_element": where(item, f"named_struct('name', {x['el_name']}, 'control_type', 'DataItem', 'value', CAST(k AS STRING))"),
        "url": where(web, "CASE WHEN k % 6 <> 0 OR kind = 'purchase' THEN concat('https://app.test/#/screen-', k % 4) ELSE '' END"),
        "element": where(web, f"named_struct('tag', {x['el_tag']}, 'css_selector', {x['el_sel']}, 'attributes', named_struct('id', {x['el_id']}, 'class', 'c', "
                              "'placeholder', CASE WHEN k % 2 = 0 THEN concat('note of ', k % 4) ELSE '' END, 'aria-label', concat('row ', k % 9)))"),
        "field": "CAST(NULL AS STRUCT<id: STRING, label: STRING, placeholder: STRING, input_type: STRING, css_selector: STRING>)",
        "previous_url": "CAST(NULL AS STRING)", "page_title": "CAST(NULL AS STRING)", "navigation_type": "CAST(NULL AS STRING)",
        "new_app": where(app, f"named_struct('app_name', {x['new_app']}, 'window_title', {x['new_title']})"),
        "previous_app": where(app, "named_struct('app_name', 'Desk', 'window_title', CAST(NULL AS STRING))"), "trigger": where(app, "'taskbar'"),
        "new_title": "CAST(NULL AS STRING)", "previous_title": "CAST(NULL AS STRING)", "text_length": "CAST(NULL AS BIGINT)", "content_type": "CAST(NULL AS STRING)",
        "trigger_reason": "CAST(NULL AS STRING)", "file_reference": "CAST(NULL AS STRUCT<filename: STRING>)", "final_text": "CAST(NULL AS STRING)",
    }
    tab = where(web, "named_struct('url', 'https://app.test/#/home', 'title', concat('Tab ', k % 2))")
    columns = {
        "schema_version": "'1'", "event_id": x["event_id"], "session_id": x["session_id"], "timestamp_ms": x["ts_ms"], "timestamp_iso": "CAST(NULL AS STRING)",
        "layer": x["layer"], "event_type": x["event_type"], "source": f"named_struct('machine_id', {x['machine']}, 'username_hash', {x['user']})",
        "context": f"named_struct('active_app', named_struct('app_name', {x['app']}, 'process_name', {x['proc']}, 'window_title', {x['title']}), 'active_browser_tab', {tab}, 'extracted_text', named_struct('text', {_TEXT}))",
        "correlation": f"named_struct('sequence_number', {x['seq']}, 'chunk_id', {x['chunk_id']}, 'ms_since_last_event', {x['gap_ms']})",
        "payload": "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in payload.items()) + ")",
        "ds": x["ds"], "chunk": x["chunk_id"],
    }
    return _events(spark, sf_dir).select(*[F.expr(v).alias(k) for k, v in columns.items()])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat log of 35 columns, as ``flatten`` makes it of the nested one (the query ``log_flatten`` compares them)."""
    return _events(spark, sf_dir).select(*[F.expr(v.format(ms="t div 1000")).alias(k) for k, v in FLAT.items()])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side table of the log's texts."""
    columns = (FLAT["event_id"], FLAT["session_id"], "t div 1000", _TEXT)
    names = ("event_id", "session_id", "ts_ms", "text")
    return _events(spark, sf_dir).where("k % 5 = 0").select(*[F.expr(c).alias(n) for c, n in zip(columns, names, strict=True)])


def write_raw(spark: SparkSession, sf_dir: str) -> str:
    """The nested log as JSON lines in ``ds=*/chunk=*`` folders; returns the root."""
    root = scratch(spark, "log")
    raw_log(spark, sf_dir).write.partitionBy("ds", "chunk").json(root)
    return root


__all__ = ["FLAT", "LOG_SCHEMA", "LOG_SQL", "log", "raw_log", "scratch", "texts", "write_raw"]
