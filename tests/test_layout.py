"""A log laid out by key and time range: windows on it don't shuffle, and it gives back its rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from tracework.catalogue import MAX_UNIT, MIN_UNIT, _units
from tracework.operators import brackets as B
from tracework.operators.scan import SLOT
from tracework.sources.event_log import activity
from tracework.sources.layout import laid_out, lay_out, whole

SF = "/root/testdata/sf0.001"


def stored(spark, path, df, behind=MAX_UNIT):
    name = f"log_{uuid.uuid4().hex}"
    lay_out(df, name, ["session_id"], "t", behind, 8, str(path / name))
    return name


def units(a):
    kind = F.col("event_type")
    return B.bracket_pairs(a, "session_id", "t", kind == "view", kind == "purchase", MAX_UNIT, MIN_UNIT)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_brackets_on_a_stored_log_need_no_exchange(spark, tmp_path):
    a = laid_out(spark, stored(spark, tmp_path, activity(spark, SF)), ["session_id"], "t", MAX_UNIT)
    got = units(a)
    assert exchanges(got) == 0 and exchanges(_units(spark, SF)) == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, _units(spark, SF).collect()))


def test_one_session_is_spread_over_buckets(spark, tmp_path):
    one = activity(spark, SF).withColumn("session_id", F.lit(1).cast("bigint"))
    a = laid_out(spark, stored(spark, tmp_path, one), ["session_id"], "t", MAX_UNIT)
    got = units(a)
    parts = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert exchanges(got) == 0 and parts > 1 and a.select(SLOT).distinct().count() > 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, units(one).collect()))


def test_a_stored_log_gives_its_rows_back_and_says_what_it_is_for(spark, tmp_path):
    rows = [(1, 5, "view"), (1, 5, "view"), (None, 7, "purchase"), (2, None, "view"), (2, MAX_UNIT * 4 - 1, None)]
    d = spark.createDataFrame(rows, "session_id bigint, t bigint, event_type string")
    name = stored(spark, tmp_path, d)
    got = whole(laid_out(spark, name, ["session_id"], "t", MAX_UNIT // 2))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows)) and got.columns == d.columns
    for keys, ts, behind in ((["session_id"], "t", MAX_UNIT + 1), (["event_type"], "t", 1), (["session_id"], "event_type", 1)):
        with pytest.raises(ValueError, match="laid out"):
            laid_out(spark, name, keys, ts, behind)
    empty = laid_out(spark, stored(spark, tmp_path, d.where("false")), ["session_id"], "t", MAX_UNIT)
    assert units(empty).count() == 0
