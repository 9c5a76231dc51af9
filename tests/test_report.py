"""Reports written as text, shares at their edges, and every reason of a refused payload."""

from pyspark.sql import functions as F

from tracework import catalogue
from tracework.functions.text import payload_refusal
from tracework.operators import report as T

SF = "/root/testdata/sf0.001"


def test_shares_and_tables_of_odd_rows(spark, tmp_path):
    d = spark.createDataFrame([("a\tb\nc", 1, 3), (None, 0, 0), ("z", 1000, 1000)], "name string, n int, total int")
    table = T.table_lines(d, {"name": F.col("name"), "share": T.share(F.col("n"), F.col("total"))}, [F.desc("n")])
    empty = T.table_lines(d.where("false"), {"name": F.col("name")}, [F.col("name")])
    got = T.written(spark, str(tmp_path / "r"), {"One": [table], "Two": [empty]})
    assert [r.text for r in got.orderBy("section", "line").collect()] == [
        "## One", "| name | share |", "|---|---|", "| z | 100.0% |", "| a b c | 33.3% |", "| - | - |", "## Two", "| name |", "|---|",
    ]


def test_every_reason_of_a_refusal(spark):
    texts = [None, "", "plain words", "x" * 20_000, "x" * 20_001, 'a "machine_id": 1', "machine_id", "in ses_20240101-123456.", "ses_2024-1", "AB12-34-5", "ABCDEFG-34-5", '"event_id" "machine_id" AB-12-3']
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.r for r in d.select("i", payload_refusal(F.col("t")).alias("r")).collect()}
    assert got == dict.fromkeys(range(12)) | {4: "too long", 5: "raw field machine_id", 7: "identifier", 9: "identifier", 11: "raw field event_id"}
    reasons = {r.reason for r in catalogue.queries()["payload_refusals"](spark, SF).select("reason").distinct().collect()}
    assert reasons == {None, "too long", "raw field machine_id", "raw field event_id", "identifier"}
