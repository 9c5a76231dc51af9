"""Benchmark decontamination: windows of normalised test words, scanned in training text.

A window is ``n`` consecutive words of a benchmark item; an item of fewer words, but not none,
is one window.  The broadcast is a sorted array of window hashes with, for each, its item and the place of
its words in the items' normalised text: hits of the hash set are verified on those words.  It takes about
20 bytes a window beside the text and is broadcast in blocks of bounded size, so a benchmark of any size
works: each further block is one more pass over the documents, which carry the spans found so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, UPPER, cut, letter_words, pieces
from .hashing import rolling

WINDOW = 10
#: Text bytes of benchmark items whose windows are broadcast at once.
BLOCK_BYTES = 16_000_000

_STATE = "text string, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


@dataclass(frozen=True)
class Windows:
    """The windows of one length: hashes in order, and for each its item and its bytes in ``Index.text``."""

    hashes: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    stops: np.ndarray


@dataclass(frozen=True)
class Index:
    names: list[str | None]
    text: bytes
    windows: dict[int, Windows]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_index(items: Iterable[tuple[str | None, bytes | None]], n: int = WINDOW) -> Index:
    """The index of all windows of ``items``, item by item."""
    names: list[str | None] = []
    texts: list[bytes] = []
    found: dict[int, list] = {}
    at = 0
    for name, text in items:
        words = letter_words(text)
        if not words:
            continue
        size = min(n, len(words))
        ends = at + np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[at], ends[:-1] + 1])
        count = len(words) - size + 1
        rows = rolling(_hashes(words), size), np.full(count, len(names), np.uint32), starts[:count].astype(np.uint32), ends[size - 1 :].astype(np.uint32)
        found.setdefault(size, []).append(rows)
        names.append(name)
        texts.append(b" ".join(words))
        at = int(ends[-1]) + 1
    windows = {}
    for size, parts in found.items():
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        windows[size] = Windows(*(c[order] for c in columns))
    return Index(names, b" ".join(texts), windows)


def find_windows(words: list[bytes], index: Index) -> list[tuple[int, int, set]]:
    """(start, length, items) of each place in ``words`` where a window stands."""
    x, found = _hashes(words), []
    for size, known in index.windows.items():
        if len(words) < size:
            continue
        h = rolling(x, size)
        low = np.searchsorted(known.hashes, h)
        for s in np.flatnonzero(known.hashes[np.minimum(low, len(known.hashes) - 1)] == h).tolist():
            here, items, k = b" ".join(words[s : s + size]), set(), int(low[s])
            while k < len(known.hashes) and known.hashes[k] == h[s]:
                if index.text[known.starts[k] : known.stops[k]] == here:  # the hash set only proposes
                    items.add(index.names[known.items[k]])
                k += 1
            if items:
                found.append((s, size, items))
    return found


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"start": a, "stop": b} for a, b in out]


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            counts, spans, items = [], batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for a, b in pieces(texts):
                words, ends = [], []
                for text in texts[a:b]:
                    words += letter_words(text)
                    ends.append(len(words))
                    words.append(b"")  # no window reaches over the end of a document
                counts += np.diff(np.array([-1, *ends])).tolist()
                found = find_windows(words, index)
                owners = np.searchsorted(ends, [s for s, _, _ in found], side="right").tolist()
                grown: dict[int, list] = {}
                for doc, (s, size, names) in zip(owners, found, strict=True):
                    first = ends[doc - 1] + 1 if doc else 0
                    grown.setdefault(a + doc, []).append((s - first, s - first + size, names))
                for doc, hits in grown.items():
                    old = [(x["start"], x["stop"]) for x in spans[doc] or ()]
                    spans[doc] = _merged(old + [h[:2] for h in hits])
                    items[doc] = sorted(set(items[doc] or ()).union(*(h[2] for h in hits)) - {None})
            counts = [max(0, c - 1) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, batch.schema.field("spans").type),
                    pa.array(items, batch.schema.field("items").type),
                ],
                names=["doc_id", "text", "n_words", "spans", "items"],
            )

    return scan


def benchmark_spans(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, text, n_words, spans, items``: the disjoint word spans (stop exclusive) that lie
    inside an occurrence of a window, and the sorted ids (as strings) of the items.

    One row per input row, repeated rows included; other columns are left out, so clashing names
    do no harm.  Null or empty text: no words, no spans.  A null item_id still marks words, but is
    not listed.  Empty tables give no rows, or no spans.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode("text", "utf-8").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(_STATE).fields])
    state = docs.select(
        "doc_id",
        "text",
        F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        index = window_index(((r.item, None if r.text is None else bytes(r.text)) for r in part.toLocalIterator()), n)
        state = state.mapInArrow(_scanner(spark.sparkContext.broadcast(index)), schema)
        if k + 1 < blocks:
            state = cut(state)
    return state


def summarise(spans: DataFrame) -> DataFrame:
    """The report of ``benchmark_spans``: counts, the digest of the items, and the verdict."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return spans.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_spans(spans: DataFrame) -> DataFrame:
    """``doc_id, text``: the words outside the spans, lower-cased and joined by one space, for
    documents that have spans; other texts stay as they are."""
    words = F.filter(F.split(F.translate("text", UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["stop"])))
    return spans.select("doc_id", F.when(F.size("spans") > 0, F.array_join(kept, " ")).otherwise(F.col("text")).alias("text"))
