"""Streams against the batch operators: bracketed and widened units, and sessions that the watermark closes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracework.catalogue import CAP, MAX_UNIT, MIN_UNIT, _units
from tracework.operators import brackets as B
from tracework.operators import sequence as Q
from tracework.sources.event_log import activity
from tracework.streaming import brackets as S
from tracework.streaming import counts as C

SF = "/root/testdata/sf0.001"


def run(df, name, path, mode="append", once=False):
    if once:  # a memory sink doesn't outlive its query
        out = f"{path}-{name}"
        q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        return df.sparkSession.read.schema(df.schema).parquet(out)
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return df.sparkSession.table(name)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END = 4_000_000_000_000_000


@pytest.fixture
def rocks(spark):
    """A session whose streams keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def files(spark, path, rows, parts=3, late=0, end=True):
    """The log in files; each row comes up to ``late`` microseconds late, a row of session -1 in the end passes all others."""
    rng = random.Random(7)
    rows = sorted(rows, key=lambda r: r[1] + rng.randint(0, late))
    cuts = [rows[i * len(rows) // parts : (i + 1) * len(rows) // parts] for i in range(parts)]
    for part in cuts + ([[(-1, END, -1, "error", 0)]] if end else []):
        rng.shuffle(part)
        d = spark.createDataFrame(part, "session_id bigint, t bigint, event_id bigint, event_type string, k int")
        d.withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def log_rows(spark):
    return [tuple(r) for r in activity(spark, SF).select("session_id", "t", "event_id", "event_type", "k").collect()]


def test_bracket_stream_equals_the_batch(rocks, tmp_path):
    hour = 3_600_000_000
    src = files(rocks, tmp_path / "in", log_rows(rocks), late=hour)
    got = run(S.bracket_stream(src, MAX_UNIT, MIN_UNIT, "1 hour"), "units", tmp_path / "c")
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(r) for r in _units(rocks, SF).collect()) and len(rows) > 20


def test_expanded_stream_equals_the_batch_of_sessions_cut_at_long_gaps(rocks, tmp_path):
    idle = MAX_UNIT + 3_600_000_000
    src = files(rocks, tmp_path / "in", log_rows(rocks), late=3_600_000_000)
    got = run(S.expanded_stream(src, MAX_UNIT, MIN_UNIT, CAP, f"{idle} us", "1 hour"), "wide", tmp_path / "c")
    cut = Q.gap_sessions(activity(rocks, SF), ["session_id"], "t", idle, ["event_id"])
    a = cut.select(F.struct("session_id", "group_no").alias("s"), "t", "event_type")
    units = B.bracket_pairs(a, "s", "t", F.col("event_type") == "view", F.col("event_type") == "purchase", MAX_UNIT, MIN_UNIT)
    want = B.expand(units, B.bounds(a, "s", "t"), "s", CAP).select("s.session_id", "start_ts", "end_ts", "wide_start", "wide_end")
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(r) for r in want.collect()) and len(rows) > 20


def test_rows_beyond_the_watermark_are_dropped_and_idle_state_goes(rocks, tmp_path):
    s, unit = 1_000_000, 600_000_000
    early = [(1, 1000 * s, 1, "view", 0), (1, 1100 * s, 2, "purchase", 0), (2, 1000 * s, 3, "view", 0)]
    on = [(3, 9000 * s, 4, "error", 0)]
    late = [(2, 1050 * s, 5, "purchase", 0), (1, 9100 * s, 6, "view", 0), (1, 9200 * s, 7, "purchase", 0), (4, 9300 * s, 8, "error", 0)]
    held = []
    for part in (early, on, late):
        src = files(rocks, tmp_path / "in", part, parts=1, end=False)
        units = run(S.bracket_stream(src, unit, 0), "late", tmp_path / "c", once=True)
        state = rocks.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "pairing").load()
        held.append({r.key[0] for r in state.collect()})
    assert held == [{1, 2}, {3}, {1, 3, 4}]  # sessions 1 and 2 are over as 3 comes, 1 begins anew
    assert sorted(tuple(r) for r in units.collect()) == [(1, 1000 * s, 1100 * s, True), (1, 9100 * s, 9200 * s, True)]


def test_closed_sessions_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    last = events.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.lit("2100-01-01 00:00:00").cast("timestamp_ntz"), "user_id": F.lit(-1).cast("bigint")})
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(C.sessions(C.event_stream(spark, str(tmp_path / "in"), 1), "6 hours"), "closed", tmp_path / "c").where("user_id >= 0")
    want = C.sessions(events.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    rows = {tuple(r) for r in got.collect()}
    assert rows == {tuple(r) for r in want.collect()} and len(rows) > 100
