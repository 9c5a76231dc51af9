"""Hard negatives by an inverted multi-index.

Rows are dealt into shards of bounded size.  Two codebooks, one for each half of a vector, put the rows of a shard into
cells; a cell's bound on the score of an anchor is the sum of two half bounds (the anchor's product with the codeword,
and its length times the radius of the codeword's rows).  A heap visits the cells of a shard by falling bound and stops
when no cell that is left can change what is asked for, so the results are exact.

Blocks of anchors meet every shard twice: first for their positives, then, with the windows of scores that these set,
for the negatives.  Each meeting is a task of bounded size and returns a few rows an anchor.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .vectordup import usable

#: Rows of a shard, anchors of a block, codewords of a half, rows of the sample that the codebooks are fitted on.
CAPACITY, BLOCK, WORDS, SAMPLE = 16_384, 512, 16, 4096
#: Rows that are scored at once, at least: at first, and at most.
CHUNK, MOST = 256, 4096
#: A negative's score as a percentage of its positive's.
LOW, HIGH = 50, 95


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component, as bigint."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))


def exact_type(largest: int, dim: int) -> type:
    """A type in which products of two vectors of ``dim`` integers up to ``largest`` are exact."""
    size = largest * largest * dim
    return np.float32 if size < 2**24 else np.float64 if size < 2**53 else object


def codebook(sample: np.ndarray, words: int = WORDS, rounds: int = 10) -> np.ndarray:
    """Centres of the rows of ``sample``, by Lloyd's rounds from evenly spaced rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.linspace(0, len(sample) - 1, min(words, len(sample))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(sample, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


class Shard:
    """The rows of a shard in the order of their cells, with the radius of each codeword's rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = x.shape[1] // 2
        parts = x[:, :half].astype(np.float64), x[:, half:].astype(np.float64)
        codes = [nearest(p, b) for p, b in zip(parts, books, strict=True)]
        self.books, self.half = books, half
        self.radii = []
        for p, b, c in zip(parts, books, codes, strict=True):
            r = np.full(len(b), -np.inf)  # a codeword without rows bounds nothing
            np.maximum.at(r, c, np.sqrt(((p - b[c]) ** 2).sum(1)))
            self.radii.append(r)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.places = np.arange(len(ids))
        self.starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))

    def visit(self, q: np.ndarray):
        """(bound, rows, scores) in chunks: no row of a chunk or a later one scores more than its bound; the first one's is infinite."""
        sides = []
        for part, book, radius in zip((q[: self.half], q[self.half :]), self.books, self.radii, strict=True):
            part = part.astype(np.float64)
            bound = np.where(radius >= 0, book @ part + np.sqrt(part @ part) * np.maximum(radius, 0), -np.inf)
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] > -np.inf]
            sides.append((bound[order].tolist(), order.tolist()))
        (b1, o1), (b2, o2) = sides
        if not b1 or not b2:
            return
        width, starts = len(self.books[1]), self.starts.tolist()
        heap, seen, cells, size, most = [(-(b1[0] + b2[0]), 0, 0)], {0}, [], 0, CHUNK
        bound = np.inf
        while heap:
            low, i, j = heapq.heappop(heap)
            if size >= most:
                yield bound, *self._scored(cells, q)
                bound, cells, size, most = 1 - low * (1 + 1e-9 if low < 0 else 1 - 1e-9), [], 0, min(2 * most, MOST)  # rounding never lowers a bound
            cell = o1[i] * width + o2[j]
            a, b = starts[cell], starts[cell + 1]
            if b > a:
                cells.append((a, b))
                size += b - a
            for m, n in ((i + 1, j), (i, j + 1)):
                if m < len(b1) and n < len(b2) and m * width + n not in seen:
                    seen.add(m * width + n)
                    heapq.heappush(heap, (-(b1[m] + b2[n]), m, n))
        if cells:
            yield bound, *self._scored(cells, q)

    def _scored(self, cells: list[tuple[int, int]], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([self.places[a:b] for a, b in cells]), np.concatenate([self.x[a:b] @ q for a, b in cells])


def _best(scores: np.ndarray, ids: np.ndarray, most: int):
    order = np.lexsort((ids, -scores))[:most]
    return scores[order], ids[order]


def positives_in(shard: Shard, anchor: int, label: int, q: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(score, id) of the first ``most`` other rows of the anchor's label, by score and then id."""
    scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for bound, rows, s in shard.visit(q):
        full = len(ids) == most
        if full and scores[-1] > bound:
            break
        if full:
            better = s >= scores[-1]
            rows, s = rows[better], s[better]
        own = (shard.labels[rows] == label) & (shard.ids[rows] != anchor)
        scores, ids = _best(np.concatenate([scores, s[own].astype(np.int64)]), np.concatenate([ids, shard.ids[rows[own]]]), most)
    return list(zip(scores.tolist(), ids.tolist(), strict=True))


def negatives_in(shard: Shard, label: int, q: np.ndarray, positives: list[int], most: int) -> list[list[tuple[int, int]]]:
    """Per positive's score (score, id) of the first ``most`` rows of other labels in its window of scores."""
    none = np.zeros(0, np.int64)
    found = [(none, none) for _ in positives]
    # a window is certified when it is full above the bound, or lies above it
    open_ = {k for k, p in enumerate(positives) if LOW * p <= HIGH * p}
    for bound, rows, s in shard.visit(q):
        full = {k: len(found[k][0]) == most for k in open_}
        open_ = {k for k in open_ if LOW * positives[k] <= 100 * bound and not (full[k] and found[k][0][-1] > bound)}
        if not open_:
            break
        # scores that can still enter a window
        least = min(int(found[k][0][-1]) if full[k] else LOW * positives[k] // 100 for k in open_)
        better = s >= least
        rows, s = rows[better], s[better].astype(np.int64)
        other = shard.labels[rows] != label
        ids, s = shard.ids[rows[other]], s[other]
        for k in open_:
            p = positives[k]
            inside = (100 * s >= LOW * p) & (100 * s <= HIGH * p)
            if inside.any():
                found[k] = _best(np.concatenate([found[k][0], s[inside]]), np.concatenate([found[k][1], ids[inside]]), most)
    return [list(zip(s.tolist(), i.tolist(), strict=True)) for s, i in found]


def _matrix(table: pa.Table) -> np.ndarray:
    return table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _packer(key: str):
    def pack(table: pa.Table) -> pa.Table:
        row = {key: table[key][:1], "ids": [table["vec_id"].to_numpy().tobytes()], "labels": [table["label"].to_numpy().tobytes()], "x": [_matrix(table).tobytes()]}
        row["windows"] = pa.array([table["windows"].to_pylist()], pa.list_(pa.list_(pa.int64())))
        return pa.table(row)

    return pack


def _meeting(books: tuple[np.ndarray, np.ndarray], top: int, per: int, kind: type):
    def meet(table: pa.Table) -> pa.Table:
        row = {r["role"]: r for r in table.to_pylist()}
        part, out = {}, []
        for role, r in row.items():
            ids = np.frombuffer(r["ids"], np.int64)
            part[role] = ids, np.frombuffer(r["labels"], np.int64), np.frombuffer(r["x"], np.int64).reshape(len(ids), -1).astype(kind)
        both = len(part) == 2  # a block or shard that no row was dealt to meets nobody
        shard = both and Shard(*part["shard"], books)
        for anchor, label, q, windows in zip(*part["block"], row["block"]["windows"], strict=True) if both else ():
            if windows is None:
                out += [(int(anchor), None, s, i) for s, i in positives_in(shard, anchor, label, q, top)]
            else:
                for p, found in zip(windows, negatives_in(shard, label, q, windows, per), strict=True):
                    out += [(int(anchor), p, s, i) for s, i in found]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("anchor_id", "window", "score", "vec_id"), columns, strict=True)})

    return meet


def _meet(shards: DataFrame, blocks: DataFrame, n_shards: int, n_blocks: int, meeting) -> DataFrame:
    """Every block with every shard, each pair a group of two rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = shards.withColumn("block", every(n_blocks)).withColumn("role", F.lit("shard"))
    b = blocks.withColumn("shard", every(n_shards)).withColumn("role", F.lit("block"))
    return a.unionByName(b).groupBy("block", "shard").applyInArrow(meeting, "anchor_id bigint, window bigint, score bigint, vec_id bigint")


def _first(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, every: int = 50, top: int = 5, per: int = 3, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors(vec_id, label, embedding)``.

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its ``top`` other rows of equal
    label with the highest integer products, its negatives for each of them the first ``per`` rows of other labels whose
    product lies between half and 95 percent of the positive's; ties go to the smaller id.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part; zero vectors
    do.  Of rows that share an id the one with the least (label, vector) counts.  Vectors of another length than the
    most frequent one take no part (the longer one on a tie).  An empty table gives no rows; extra columns of any name
    are left out.  The codebooks are fitted on ``SAMPLE`` rows; every row is indexed, and results don't depend on them.
    """
    spark = vectors.sparkSession
    vector = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (usable(vector) | (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(x == 0, F.lit(False))))
    rows = vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding").where(fine)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", scaled(F.col("r.embedding")).alias("x"))
    rows = keep(rows, "negative-rows")
    dims = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"))
    first = dims.orderBy(F.desc("n"), F.desc("dim")).first()
    if first is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    dim, n = first["dim"], first["n"]
    rows = rows.where(F.size("x") == dim)
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_shards, n_blocks = -(-n // capacity), max(1, -(-anchors.count() // block))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").collect()
    x = np.array([r["x"] for r in sample], np.float64)
    meeting = _meeting((codebook(x[:, : dim // 2]), codebook(x[:, dim // 2 :])), top, per, exact_type(first["most"] or 0, dim))

    window = F.lit(None).cast("array<bigint>")
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"), "windows": window})
    schema = "int, ids binary, labels binary, x binary, windows array<array<bigint>>"
    shards = keep(dealt.groupBy("shard").applyInArrow(_packer("shard"), "shard " + schema), "negative-shards")
    number = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")
    blocks = lambda df: df.withColumn("block", number).groupBy("block").applyInArrow(_packer("block"), "block " + schema)

    positives = _first(_meet(shards, blocks(anchors.withColumn("windows", window)), n_shards, n_blocks, meeting), ["anchor_id"], top)
    positives = keep(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("window")), "negative-positives")
    windows = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("window")).alias("windows"))  # of ``top`` at most
    found = _first(_meet(shards, blocks(anchors.join(windows, "vec_id")), n_shards, n_blocks, meeting), ["anchor_id", "window"], per)
    out = positives.join(found, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 7 get the next label, after 9 comes 0."""
    other = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", other.alias("label"), "embedding")
