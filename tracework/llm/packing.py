"""Packing into windows of bounded size by Karmarkar-Karp multiway differencing.

Within a partition documents stream into pools of about ``WINDOWS`` windows; whatever exceeds a
window is cut off as full windows first.  A pool's pieces become partial partitions, and the two
with the widest spread are merged with opposing imbalances until one near-equal partition is left.
If one of its windows exceeds the capacity, the pool is partitioned again into one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

CAPACITY = 2048
END = 1
#: Windows of a pool, and the room that is left in it, so that near-equal windows all fit.
WINDOWS, SPARE = 96, 512
#: Tokens of a pool that are cut into small pieces of so many tokens, which level its windows.
FINE, SMALL = 8192, 64

_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` groups of near-equal sums."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [i] + [None] * (k - 1)))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, inner_a = heapq.heappop(heap)
        _, _, b, inner_b = heapq.heappop(heap)
        sums = a + b[::-1]  # the largest of one with the smallest of the other
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        merged = [(x, y) if y is not None and x is not None else x if y is None else y for x, y in zip(inner_a, reversed(inner_b), strict=True)]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, [merged[j] for j in order.tolist()]))
        tie += 1
    groups = []
    for tree in heap[0][3] if heap else []:
        group, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            elif node is not None:
                group.append(node)
        groups.append(sorted(group))
    return groups


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of ``sizes`` in windows of at most ``capacity``, as few as differencing finds; no size may exceed it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = [g for g in difference(sizes, k) if g]
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        k += 1


def levelled(pool: list[tuple]) -> list[tuple]:
    """``pool`` of (name, ids, start, length) with its last ``FINE`` tokens in pieces of ``SMALL``."""
    out, fine = [], 0
    for name, data, start, length in reversed(pool):
        step = SMALL if fine < FINE else length
        out += [(name, data, start + at, min(step, length - at)) for at in range(0, length, step)]
        fine += length
    return out


def _packer(tokenizer: str, kind: str, capacity: int, pool_windows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, kind), np.array([END], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        pool: list[tuple] = []  # doc_id, ids, start, length
        filled, target = 0, pool_windows * capacity - SPARE

        def piece(doc_id, data: bytes, start: int, length: int) -> tuple:
            return doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), len(data) // 4

        def close() -> None:
            nonlocal sequence, pool, filled
            pool = levelled(pool)
            for group in windows([p[3] for p in pool], capacity):
                offset = 0
                for i in group:
                    rows.append((*piece(*pool[i]), sequence, offset))
                    offset += pool[i][3]
                sequence += 1
            pool, filled = [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DDL.split(", ")])

        for batch in batches:
            coded = (ids for part_of in encode.batches(batch.column(1)) for ids in part_of)
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                data = ids + end
                start, n = 0, len(data) // 4
                while n - start >= capacity:
                    rows.append((*piece(doc_id, data, start, capacity), sequence, 0))
                    sequence, start = sequence + 1, start + capacity
                while start < n:
                    length = min(n - start, target - filled)
                    pool.append((doc_id, data, start, length))
                    start, filled = start + length, filled + length
                    if filled == target:
                        close()
            if len(rows) >= 20_000:
                yield flush()
        if pool:
            close()
        if rows:
            yield flush()

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    kind: str = "byte",
    capacity: int = CAPACITY,
    pool_windows: int = WINDOWS,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece.

    Every id of every row's whole text, and the end id 1 behind it, lies in exactly one piece.
    Null and empty texts have the end id alone; a null doc_id stays null.  Repeated rows are packed
    each for itself; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, kind, capacity, pool_windows), _DDL)
