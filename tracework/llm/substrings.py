"""Substring dedup: windows of words that start in more than one place, found in two passes.

Pass one: each batch of documents yields a sparse count-min sketch of its windows, and the sketches
are merged by summing cells.  A window is counted under its anchor, the 8-word shingle of it with
the least hash: equal windows have equal anchors at equal places, so an anchor's count is never
below its windows' counts, and a batch only has to count the few anchors.  Pass two: windows whose
anchor is estimated to occur twice are grouped exactly, by 96-bit fingerprints; no other window
can be repeated.  Of a window that a batch holds several times one row leaves the batch, so hot
passages don't meet in one task.

The merged sketch is broadcast as one bit per cell (count of 2 or more): ``ROWS * CELLS / 8`` bytes,
32 MB by default, at any input.  A corpus of far more than ``CELLS`` anchors (about 14 words each)
fills it up; pass two then groups more windows, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, plain_words
from .hashing import least, pair, rolling

WINDOW = 35
SHINGLE = 8
#: Cells of one row of the sketch, as a power of two, and its rows.
CELL_BITS, ROWS = 27, 2

_U = np.uint64
_PLACE = (1 << 28) - 1


class _Batch:
    """Windows of some documents: word hashes ``x``, valid ``starts``, and each start's anchor place."""

    def __init__(self, texts: list[bytes | None], n: int) -> None:
        words, lengths = [], []
        for text in texts:
            own = plain_words(text)
            lengths.append(len(own))
            words += own
        self.x = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
        self.ends = np.cumsum(lengths)
        left = np.repeat(self.ends, lengths) - np.arange(len(words))
        self.starts = np.flatnonzero(left >= n)
        shingle = min(SHINGLE, n)
        if len(self.starts):
            self.shingles = rolling(self.x, shingle)
            order = (self.shingles & ~_U(_PLACE)) | np.arange(len(self.shingles), dtype=_U)
            lowest = least(order, n - shingle + 1)
            self.anchors = (lowest[self.starts] & _U(_PLACE)).astype(np.int64)

    def owners(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = np.searchsorted(self.ends, starts, side="right")
        return docs, starts - np.concatenate([[0], self.ends])[docs]


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    return [
        (pair(anchors, anchors, 101 + r) >> _U(64 - bits)).astype(np.int64) + (r << bits) for r in range(ROWS)
    ]


def _sketcher(n: int, bits: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = []
            for a, b in pieces(texts):
                part = _Batch(texts[a:b], n)
                if len(part.starts):
                    found += _cells(part.shingles[np.unique(part.anchors)], bits)
            cells, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], names=["cell", "n"])

    return sketch


def _collector(n: int, bits: int, repeated):
    """Rows of windows that may be repeated: fingerprint (a, b), document (doc_id, tag), start, and
    span: 0, or for places that are repeated for certain the number of window starts from there on."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(repeated.value, np.uint8)
        for batch in batches:
            ids = batch.column("doc_id")
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            for first, last in pieces(texts, 8_000_000):
                part = _Batch(texts[first:last], n)
                if not len(part.starts):
                    continue
                places, back = np.unique(part.anchors, return_inverse=True)
                seen = np.ones(len(places), bool)
                for cell in _cells(part.shingles[places], bits):
                    seen &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                starts = part.starts[seen[back]]
                if not len(starts):
                    continue
                a, b = rolling(part.x, n, 7)[starts], rolling(part.x, n, 1 << 20)[starts]
                b &= ~_U(0xFFFFFFFF)
                order = np.lexsort((starts, b, a))
                a, b, starts = a[order], b[order], starts[order]
                fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                twice = ~fresh | np.concatenate([~fresh[1:], [False]])
                # repeated within the batch: spans of consecutive starts, and one row that tells others
                sure = np.sort(starts[twice])
                doc, place = part.owners(sure)
                new = np.ones(len(sure), bool)
                new[1:] = (sure[1:] != sure[:-1] + 1) | (doc[1:] != doc[:-1])
                runs = np.flatnonzero(new)
                lengths = np.diff([*runs, len(sure)])
                spread = pair(sure[runs].astype(_U), _U(first) + sure[runs].astype(_U), 3)
                yield _rows(spread, spread, ids, tags, first + doc[runs], place[runs], lengths)
                one = np.flatnonzero(fresh)
                one = one[np.argsort(starts[one])]  # a document's rows side by side take less room in the shuffle
                doc, place = part.owners(starts[one])
                yield _rows(a[one], b[one], ids, tags, first + doc, place, -twice[one].astype(np.int64))

    return collect


def _rows(a, b, ids, tags, docs, starts, spans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a.view(np.int64)),
            pa.array((b >> _U(32)).astype(np.uint32).view(np.int32)),
            ids.take(pa.array(docs)),
            pa.array(tags[docs] << 32 | starts),
            pa.array(spans.astype(np.int32)),
        ],
        names=["a", "b", "doc_id", "place", "span"],
    )


def _matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (a, b): the places of windows that stand beside an equal one, as runs of 1,
    and those that were sure before."""
    held: pa.RecordBatch | None = None

    def out(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
        spans = np.maximum(batch.column("span").to_numpy(zero_copy_only=False), 1)
        rows = pa.array(np.flatnonzero(keep))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("place").take(rows), pa.array(spans[keep])],
            names=["doc_id", "place", "span"],
        )

    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        keep, last = _repeated(batch)
        tail = max(last, batch.num_rows - 2)  # the last group may go on in the next batch; two rows are enough to tell
        held = batch.slice(tail)
        yield out(batch.slice(0, tail), keep[:tail])
    if held is not None:
        keep, _ = _repeated(held)
        yield out(held, keep)


def _repeated(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
    a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
    spans = batch.column("span").to_numpy(zero_copy_only=False)
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (spans[1:] <= 0) & (spans[:-1] <= 0)
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (spans > 0)
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    return keep, int(starts[-1])


def repeated_words(docs: DataFrame, n: int = WINDOW, cell_bits: int = CELL_BITS) -> DataFrame:
    """``doc_id, text, places``: places are (start, count) runs, packed as little-endian 32-bit pairs,
    of windows of ``n`` words that also start somewhere else; null where there are none.

    One row per input row.  Repeated rows count as places of their own, so their windows are
    repeated.  Null, empty and short texts have no windows; other columns are left out; an empty
    table gives no rows; rows with a null doc_id take part like others.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tag", F.shiftrightunsigned(F.xxhash64("text"), 33))  # tells rows of one doc_id apart
    cells = rows.select("text").mapInArrow(_sketcher(n, cell_bits), "cell bigint, n bigint")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").select((F.col("cell") + 1).alias("cell"))
    bits = cells.groupBy(F.bitmap_bucket_number("cell").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")
    )
    sketch = np.zeros((ROWS << cell_bits) // 8, np.uint8)
    for r in bits.toLocalIterator():
        sketch[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)[: len(sketch) - (r.k - 1) * 4096]
    repeated = spark.sparkContext.broadcast(sketch.tobytes())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_collector(n, cell_bits, repeated), f"a bigint, b int, doc_id {id_type}, place bigint, span int")
    found = found.repartition(F.col("a"), F.col("b")).sortWithinPartitions("a", "b")
    found = found.mapInArrow(_matcher, f"doc_id {id_type}, place bigint, span int")
    runs = found.groupBy(F.col("doc_id").alias("run_id"), F.shiftright("place", 32).alias("run_tag")).agg(
        F.collect_list(F.struct(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"), "span")).alias("places")
    )
    same = F.col("doc_id").eqNullSafe(F.col("run_id")) & (F.col("tag") == F.col("run_tag"))
    return rows.join(runs, same, "left").select("doc_id", "text", "places")


def _stripper(n: int):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            places = batch.column("places").to_pylist()
            for text, runs in zip(batch.column("text").cast(pa.binary()), places, strict=True):
                words = plain_words(text.as_py())
                counts.append(len(words))
                if runs:
                    change = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        change[r["start"]] += 1
                        change[r["start"] + r["span"] + n - 1] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return strip


def without_repeats(found: DataFrame, n: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of what ``repeated_words`` found: the words outside all
    repeated windows, joined by one blank (empty where none is left)."""
    id_type = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_stripper(n), f"doc_id {id_type}, n_words bigint, n_removed bigint, kept string")
