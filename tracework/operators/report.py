"""Reports of several sections in Markdown: each section a table of few rows and a sentence, written as text and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """A share as text, in per cent with one digit, rounded down; ``-`` of nothing."""
    tenths = F.floor(1000 * part / F.nullif(whole, F.lit(0)))
    return F.coalesce(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%")), F.lit("-"))


def sentence(df: DataFrame, text: Column) -> DataFrame:
    """``line, text``: a sentence of each row of a table of one row."""
    return df.select(F.lit(0).cast("bigint").alias("line"), text.alias("text"))


def table_lines(df: DataFrame, columns: dict[str, Column], order: list[Column]) -> DataFrame:
    """``line, text``: a table's head, its rule, and a line a row; ``df`` is a report's table, a top-k or one row a class.
    A null cell is printed as ``-``."""
    cells = [F.coalesce(c.cast("string"), F.lit("-")) for c in columns.values()]
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 2).cast("bigint").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"))
    head = [(1, f"| {' | '.join(columns)} |"), (2, f"|{'---|' * len(columns)}")]
    return df.sparkSession.createDataFrame(head, "line bigint, text string").unionByName(body)


def written(spark: SparkSession, path: str, sections: dict[str, list[DataFrame]]) -> DataFrame:
    """Writes sections (title to parts of ``line, text``) as one text table under ``path``; ``section, line, text`` from there.

    Title lines have number -1, sentences 0.  A tab in a text becomes a space, a line break too.
    """
    rows = []
    for n, (title, parts) in enumerate(sections.items(), 1):
        head = spark.createDataFrame([(-1, f"## {title}")], "line bigint, text string")
        rows += [p.select(F.lit(n).alias("section"), "line", "text") for p in [head, *parts]]
    lines = reduce(DataFrame.unionByName, rows).withColumn("text", F.regexp_replace("text", r"[\t\r\n]", " "))
    lines.select(F.concat_ws("\t", "section", "line", "text").alias("value")).write.text(path)
    cut = F.split("value", "\t")
    return spark.read.text(path).select(cut[0].cast("int").alias("section"), cut[1].cast("bigint").alias("line"), cut[2].alias("text"))
