"""Sources and sinks: the driver's event table in the roles of an activity log, nested JSON logs, segments."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; a local session may do without the setting."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "tracework")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: its lineage ends."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, t (microseconds), event_id, event_type, k``: users as sessions; time zones play no part."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), t.alias("t"), "event_id", "event_type", k.alias("k"))


LOG_SCHEMA = """
schema_version string, event_id string, session_id string, timestamp_ms bigint, timestamp_iso string, layer string, event_type string,
source struct<machine_id: string, username_hash: string>,
context struct<active_app: struct<app_name: string, process_name: string, window_title: string>,
  active_browser_tab: struct<url: string, title: string>, extracted_text: struct<text: string>>,
correlation struct<sequence_number: bigint, chunk_id: string, ms_since_last_event: bigint>,
payload struct<key: string, character: string, keys: array<string>, modifiers: map<string, boolean>, action_hint: string,
  target_field: struct<name: string, control_type: string, value: string>,
  target_element: struct<name: string, control_type: string, value: string>,
  url: string, element: struct<tag: string, css_selector: string, attributes: struct<id: string, `class`: string, placeholder: string, `aria-label`: string>>,
  field: struct<id: string, label: string, placeholder: string, input_type: string, css_selector: string>,
  previous_url: string, page_title: string, navigation_type: string,
  new_app: struct<app_name: string, window_title: string>, previous_app: struct<app_name: string, window_title: string>, trigger: string,
  new_title: string, previous_title: string, text_length: bigint, content_type: string, trigger_reason: string,
  file_reference: struct<filename: string>, final_text: string>
"""

#: Columns that depend on the type of an event: per column the types and the part of the payload that holds it.
_BY_TYPE: dict[str, list[tuple[str, str]]] = {
    "key": [("keystroke", "key"), ("shortcut", "keys")],
    "char": [("keystroke", "character")],
    "mods": [("keystroke shortcut", "modifiers")],
    "el_name": [
        ("keystroke text_input_complete", "target_field.name"),
        ("mouse_click mouse_double_click", "target_element.name"),
        ("browser_click", "element.attributes.placeholder|element.attributes.`aria-label`"),
        ("browser_form_input", "field.label|field.placeholder"),
        ("browser_navigation", "page_title"),
    ],
    "el_type": [("keystroke", "target_field.control_type"), ("mouse_click mouse_double_click", "target_element.control_type"), ("browser_form_input", "field.input_type")],
    "el_value": [("keystroke", "target_field.value"), ("mouse_click mouse_double_click", "target_element.value"), ("text_input_complete", "final_text")],
    "hint": [
        ("shortcut", "action_hint"), ("browser_navigation", "navigation_type"), ("app_switch", "trigger"),
        ("clipboard_change", "content_type"), ("screenshot_smart", "trigger_reason"),
    ],
    "el_id": [("browser_click", "element.attributes.id"), ("browser_form_input", "field.id")],
    "el_class": [("browser_click", "element.attributes.`class`")],
    "el_tag": [("browser_click", "element.tag")],
    "el_sel": [("browser_click", "element.css_selector"), ("browser_form_input", "field.css_selector")],
    "prev_url": [("browser_navigation", "previous_url")],
    "new_app": [("app_switch", "new_app.app_name")],
    "prev_app": [("app_switch", "previous_app.app_name")],
    "new_title": [("app_switch", "new_app.window_title"), ("window_title_change", "new_title")],
    "prev_title": [("app_switch", "previous_app.window_title"), ("window_title_change", "previous_title")],
    "clip_len": [("clipboard_change", "text_length")],
    "shot": [("screenshot_smart", "file_reference.filename")],
}


def _part(name: str) -> Column:
    """A part of the payload: the first of its alternatives that is not empty."""
    if name == "keys":
        return F.array_join("payload.keys", "+")
    if name == "modifiers":
        return F.nullif(F.array_join(F.map_keys(F.map_filter("payload.modifiers", lambda k, v: v)), "+"), F.lit(""))
    first, *others = [F.col(f"payload.{x}") for x in name.split("|")]
    return F.coalesce(F.nullif(first, F.lit("")), *others) if others else first


def flatten(raw: DataFrame, ds: Column) -> DataFrame:
    """Nested events as one row of 35 columns each; absent parts are null."""
    kind = F.col("event_type")
    web = kind.isin("browser_click", "browser_form_input", "browser_navigation")
    tab = F.col("context.active_browser_tab.url")
    typed = []
    for column, parts in _BY_TYPE.items():
        value = F.lit(None)
        for kinds, name in parts:
            value = F.when(kind.isin(kinds.split()), _part(name)).otherwise(value)
        typed.append(value.alias(column))
    return raw.select(
        ds.alias("ds"), "session_id", F.col("correlation.chunk_id").alias("chunk_id"), F.col("correlation.sequence_number").alias("seq"),
        "event_id", F.col("timestamp_ms").alias("ts_ms"), "event_type", "layer",
        F.col("correlation.ms_since_last_event").alias("gap_ms"), F.col("source.machine_id").alias("machine"), F.col("source.username_hash").alias("user"),
        F.col("context.active_app.app_name").alias("app"), F.col("context.active_app.process_name").alias("proc"), F.col("context.active_app.window_title").alias("title"),
        F.when(web, F.coalesce(F.nullif(F.col("payload.url"), F.lit("")), tab)).otherwise(tab).alias("url"),
        F.col("context.active_browser_tab.title").alias("tab_title"),
        F.coalesce(F.col("context.extracted_text.text") != "", F.lit(False)).alias("has_text"),
        *typed,
    )


def texts(raw: DataFrame) -> DataFrame:
    """The side table ``event_id, session_id, ts_ms, text`` of the events that carry a text."""
    text = F.col("context.extracted_text.text")
    return raw.where(text != "").select("event_id", "session_id", F.col("timestamp_ms").alias("ts_ms"), text.alias("text"))


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """All ``ds=*/session=*/chunk=*`` JSON lines below ``root``, with ``ds`` and ``chunk`` of their folders; blank lines are skipped."""
    raw = spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", True).json(root)
    folder = lambda name: F.regexp_extract("_metadata.file_path", f"/{name}=([^/]+)/", 1)
    return raw.where("event_id is not null or event_type is not null").withColumns({"ds": folder("ds"), "chunk": folder("chunk")})


def read_log(spark: SparkSession, root: str) -> DataFrame:
    raw = read_raw(spark, root)
    return flatten(raw, F.col("ds"))


def log_order(log: DataFrame) -> list[Column]:
    """The order of events within a session: time, sequence number (0 if it lacks one), id."""
    return [F.col("ts_ms"), F.coalesce("seq", F.lit(0)), F.col("event_id")]


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``; an error that names what is missing if it has no row."""
    if df.isEmpty():
        raise FileNotFoundError(f"no {what} found: check the data folder")
    return df


MANIFEST_SCHEMA = """session_id string, session struct<start_ts: bigint, end_ts: bigint>,
processes array<struct<code: string, executions: array<struct<start_ts: bigint, end_ts: bigint, seq: bigint>>>>"""


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def gold_runs(manifests: DataFrame) -> DataFrame:
    """``session_id, code, start_ts, end_ts, inferred_end``: the executions of all processes of a session.

    A missing end is the next start of the session; no end lies behind the session's.  Executions without a start
    or without length are dropped, after the starts have served their neighbours.
    """
    runs = manifests.select("session_id", F.col("session.end_ts").alias("stop"), F.explode("processes").alias("p"))
    runs = runs.select("session_id", "stop", F.col("p.code").alias("code"), F.explode("p.executions").alias("x"))
    runs = runs.select("session_id", "stop", "code", "x.*").where("start_ts is not null")
    nxt = F.lead("start_ts").over(Window.partitionBy("session_id").orderBy("start_ts", "seq"))
    end = F.least(F.coalesce("end_ts", nxt, "stop"), F.col("stop"))
    runs = runs.select("session_id", "code", "start_ts", end.alias("end_ts"), F.col("end_ts").isNull().alias("inferred_end"))
    return runs.where("end_ts > start_ts")


def write_segments(units: DataFrame, path: str) -> None:
    """JSON lines of session_id, start, end (whole seconds, cut off) and label."""
    iso = lambda c: F.date_format(F.timestamp_micros(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    units.select("session_id", iso("start_ts").alias("start"), iso("end_ts").alias("end"), "label").write.json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("session_id string, start string, end string, label string").json(path)
    ms = lambda c: F.unix_millis(F.to_timestamp(c))
    return raw.withColumn("start_ms", ms("start")).withColumn("end_ms", ms("end")).withColumn("dur", (F.col("end_ms") - F.col("start_ms")) / 1000)
