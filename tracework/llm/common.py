"""What the training-data operators share: tables, the shared folder, word rules, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Java / RE2 class of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
#: What separates letter-and-digit words, before any lower-casing.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_DELIMITED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may do without it and gets a temporary folder; on a cluster that folder would
    be the driver's own, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tracework-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: its rows go to the shared folder and its lineage ends there."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{use_checkpoints(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def letter_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(_DELIMITED).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text."""
    return text.split() if text else []


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``most`` bytes together."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += size + 8
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def pieces(texts: list[bytes | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes, so that word lists stay small."""
    return runs([len(text or b"") for text in texts], most)


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: its lineage ends."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
