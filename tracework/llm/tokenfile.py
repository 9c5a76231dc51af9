"""Token files: ids of all documents in ascending doc_id order, range-coded in checked blocks.

A file set is a Parquet folder whose rows are segments of whole documents (about ``SEGMENT`` ids): the
shared frequency table, each block's checkpoint (lane states, place in the word stream, CRC-32 of
its ids) and the words.  A segment holds all that its decoding needs, so segments are written and
read by independent tasks, and a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .tokens import encoder

END = 1
SEGMENT = 48 * rans.BLOCK

_SEGMENTS = pa.schema(
    [
        ("part", pa.int64()),
        ("seq", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_lengths", pa.list_(pa.int64())),
        ("n_tokens", pa.int64()),
        ("table", pa.binary()),
        ("states", pa.binary()),
        ("block_starts", pa.list_(pa.int64())),
        ("block_crcs", pa.list_(pa.int64())),
        ("words", pa.binary()),
    ]
)
_DDL = (
    "part bigint, seq bigint, doc_ids array<bigint>, doc_lengths array<bigint>, n_tokens bigint, table binary, "
    "states binary, block_starts array<bigint>, block_crcs array<bigint>, words binary"
)


def pack_segment(ids: np.ndarray) -> dict:
    """The stored form of one segment's ids."""
    names, freq = rans.frequencies(ids)
    states, words = rans.encode(ids, names, freq)
    crcs = [zlib.crc32(ids[i : i + rans.BLOCK].astype("<u4")) for i in range(0, len(ids), rans.BLOCK)]
    table = np.concatenate([np.diff(names, prepend=0), freq]).astype("<u4")
    return {
        "n_tokens": len(ids),
        "table": zlib.compress(table.tobytes(), 6),
        "states": states.astype("<u8").tobytes(),
        "block_starts": np.cumsum([0, *map(len, words)])[:-1].tolist(),
        "block_crcs": crcs,
        "words": np.concatenate(words).astype("<u4").tobytes(),
    }


def unpack_segment(row: dict) -> np.ndarray:
    """The ids of a stored segment; an error if any block fails its checksum."""
    table = np.frombuffer(zlib.decompress(row["table"]), "<u4").astype(np.int64)
    names, freq = np.cumsum(table[: len(table) // 2]), table[len(table) // 2 :]
    states = np.frombuffer(row["states"], "<u8").reshape(-1, rans.LANES)
    words, starts = np.frombuffer(row["words"], "<u4"), np.array(row["block_starts"])
    ids = rans.decode(states, words, starts, names.astype("<u4"), freq).reshape(-1)[: row["n_tokens"]]
    for i, crc in enumerate(row["block_crcs"]):
        if zlib.crc32(np.ascontiguousarray(ids[i * rans.BLOCK : (i + 1) * rans.BLOCK])) != crc:
            raise ValueError(f"block {i} of segment {row['part']}/{row['seq']} fails its checksum")
    return ids


def _writer(tokenizer: str, kind: str, segment: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        end = np.array([END], "<u4").tobytes()
        names: list[int | None] = []
        data: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            packed = pack_segment(np.frombuffer(b"".join(data), "<u4").astype(np.int64))
            row = {"part": part, "seq": seq, "doc_ids": names, "doc_lengths": [len(d) // 4 for d in data], **packed}
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENTS)

        for batch in batches:
            coded = (ids for part_of in encode.batches(batch.column(1)) for ids in part_of)
            for name, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                names.append(name)
                data.append(ids + end)
                size += len(data[-1]) // 4
                if size >= segment:
                    yield close()
                    names, data, size, seq = [], [], 0, seq + 1
        if data:
            yield close()

    return write


def write_token_file(docs: DataFrame, path: str, tokenizer: str, kind: str = "word", segment: int = SEGMENT) -> None:
    """Writes the ids of every row's whole text, each followed by id 1, to ``path``.

    Null and empty texts have the end id alone.  Rows with a null doc_id come first; rows of one
    doc_id stand side by side, in the order of their texts.  Other columns are not read, so clashing
    names do no harm; an empty table makes an empty file set.  A segment closes behind the document
    that fills it, so a very long text makes one long segment.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    rows.mapInArrow(_writer(tokenizer, kind, segment), _DDL).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_segment(row)
            stops = np.cumsum(row["doc_lengths"])
            crcs = [zlib.crc32(ids[b - n : b]) for b, n in zip(stops.tolist(), row["doc_lengths"], strict=True)]
            n = len(stops)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * n, pa.int64()),
                    pa.array([row["seq"]] * n, pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(stops - np.array(row["doc_lengths"]), pa.int64()),
                    pa.array(row["doc_lengths"], pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files at ``path``.

    One row per written row, repeated rows and null ids included; an empty file set gives no rows; a
    block that fails its checksum is an error.  A task holds one segment, so a document must fit into
    a task.  The window over the parts sees one row per write task.
    """
    rows = spark.read.schema(_DDL).parquet(path)
    read = rows.mapInArrow(
        _read, "part bigint, seq bigint, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # prefix sums in two levels: over the parts (few rows), then over each part's segments
    segments = rows.select("part", "seq", "n_tokens")
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.select("part", "seq", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("seq_start"))
    starts = segments.join(parts, "part")
    return read.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("part_start") + F.col("seq_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
