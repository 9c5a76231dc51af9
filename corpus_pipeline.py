"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, packing.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and works on all rows that the stage before
kept.  All but the last return the columns of ``docs``, extra ones included.  Null and empty texts fail the
quality rules; where a later stage meets them they stay, without hits, and give one end id in packing.
Texts of any length are worked on whole; an empty table gives no rows at every stage; repeated rows and null
ids are treated as the stages and operators state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracework.llm.common import SPACE, keep, table
from tracework.llm.decontaminate import benchmark_spans
from tracework.llm.neardup import near_duplicates
from tracework.llm.packing import pack_documents
from tracework.llm.quality import quality
from tracework.llm.queries import BYTE_FILE
from tracework.llm.secrets import labelled_sample, redacted, secret_scan, train

#: SQL cannot express the packing stage.
ORACLE_SQL = None


#: Near-dedup stage: documents are linked from this similarity of their shingle sets on (op6 has its own, 85).
#: 30 bands of 4 registers miss a pair at exactly 80 % with 1.4e-7, the estimate filter with less than that.
SIMILAR = {"threshold": 80, "bands": 30, "m": 120, "margin": 0.25}


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _with_text(docs: DataFrame, rows: DataFrame, text) -> DataFrame:
    """``rows`` of (doc_id: struct of the other columns, text) as rows of ``docs``, with n_chars to match."""
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"doc_id.`{c}`").alias(c))
    return rows.select(*columns)


def _packed(docs: DataFrame) -> DataFrame:
    """The other columns as one struct that stands in for the id, beside the text."""
    return docs.select(F.struct(*[c for c in _names(docs) if c != "`text`"]).alias("doc_id"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    rows = quality(_packed(docs)).where("quality.kept")
    return _with_text(docs, rows, F.col("quality.clean_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id.

    Rows that share a doc_id are linked as one document; of those that stay, rows of equal words are one,
    and rows of one id with different words all stay.  Rows without an id stay.
    """
    kept = near_duplicates(docs, **SIMILAR).where("kept and doc_id is not null").select("doc_id").distinct()
    text = F.lower(F.col("row.text"))
    words = F.xxhash64(F.regexp_replace(text, SPACE + "+", " "), text.isNull())
    plain = [F.col(f"row.{c}") for c in _names(docs) if not docs.schema[c.strip("`")].dataType.typeName().startswith(("map", "variant"))]
    # the join deals rows by doc_id already, so the window needs no further shuffle
    rows = docs.select("doc_id", F.struct(*_names(docs)).alias("row")).join(kept, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "words").orderBy("hash"))
    one = rows.withColumns({"words": words, "hash": F.xxhash64(*plain)}).withColumn("nth", first).where("nth = 1").select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    rows = benchmark_spans(_packed(docs), table(spark, sf_dir, "benchmark")).where(F.size("spans") == 0)
    return _with_text(docs, rows, F.col("text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the values of its secrets replaced."""
    rows = secret_scan(_packed(docs), train(labelled_sample(docs)))
    return _with_text(docs, rows, redacted(rows))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, BYTE_FILE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", redact_secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
