"""Near-duplicate documents: SetSketch bands propose, joint likelihood filters, full sets confirm.

Documents with equal shingle sets form a class with one representative, so copies cost nothing
further.  Representatives whose registers agree in a band share a bucket.  Two rounds find links:

1. each bucket pairs its members with its first one; confirmed links give components;
2. buckets that still hold several components compare members of different components: small ones
   pair by pair, large ones in blocks of bounded size that are matched exactly inside one task.

Pairs inside a component are never expanded, and no pair of a bucket is left unchecked unless its
two documents are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pieces
from .graph import components
from .hashing import rolling
from .setsketch import REGISTERS, registers, similarity

SHINGLE = 5
BANDS = 20
THRESHOLD = 85
#: Pairs whose estimate lies this far (4 standard errors) below the threshold are not looked at.
MARGIN = 0.17
#: Buckets of more members are compared in blocks of ``BLOCK`` documents a side.
SMALL, BLOCK = 64, 256

_U = np.uint64


def shingle_sets(texts: list[bytes | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``n``-word shingles, A-Z lower-cased; with fewer
    words the whole sequence is one shingle; no words, no shingles."""
    words, lengths = [], []
    for text in texts:
        own = text.lower().split() if text else []
        lengths.append(len(own))
        words += own
    x = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    h = rolling(x, n)
    out, start = [], 0
    for size in lengths:
        if size >= n:
            out.append(np.unique(h[start : start + size - n + 1]))
        elif size:
            out.append(rolling(x[start : start + size], size, 1000 + size))
        else:
            out.append(np.zeros(0, _U))
        start += size
    return out


def _signer(n: int, m: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in pieces(texts, 4_000_000):
                sets = shingle_sets(texts[a:b], n)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                regs: list[bytes | None] = [None] * len(sets)
                keys: list[list[int] | None] = [None] * len(sets)
                if len(full):
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    r = registers(np.concatenate([sets[i] for i in full]), starts, m)
                    for i, row in zip(full.tolist(), r, strict=True):
                        regs[i] = row.tobytes()
                        step = 2 * m // bands
                        keys[i] = [xxhash.xxh3_64_intdigest(regs[i][k : k + step], k) - (1 << 63) for k in range(0, 2 * m, step)]
                prints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(sizes),
                        pa.array([(p >> 64) - (1 << 63) for p in prints], pa.int64()),
                        pa.array([(p & (2**64 - 1)) - (1 << 63) for p in prints], pa.int64()),
                        pa.array(regs, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "ka", "kb", "regs", "bands"],
                )

    return sign


def _matrix(column, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, m)


def _estimator(m: int, least: float):
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
                j = similarity(_matrix(batch.column("regs_a"), m), _matrix(batch.column("regs_b"), m), *sizes)
                yield batch.select(["a", "b"]).filter(pa.array(j >= least))

    return estimate


def _set_maker(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in pieces(texts, 4_000_000):
                data = [s.tobytes() for s in shingle_sets(texts[a:b], n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(data, pa.binary())], names=["doc_id", "shingles"])

    return make


def _confirmer(threshold: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = (np.frombuffer(s.as_py(), _U) for s in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def _block_links(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, comps: np.ndarray, threshold: int):
    """(i, j) of linked documents of different components, as few as connect what is connected."""
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    both = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    for low in range(0, len(values), 4096):  # shared shingles, a bounded number of them at a time
        a, b = np.searchsorted(index, [low, low + 4096])
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[owner[a:b], index[a:b] - low] = 1
        both += grid[rows] @ grid[columns].T
    linked = 100 * both >= threshold * (sizes[rows][:, None] + sizes[columns][None, :] - both)
    linked &= comps[rows][:, None] != comps[columns][None, :]
    parent = {int(c): int(c) for c in np.unique(comps)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    for i, j in zip(*np.nonzero(linked), strict=True):
        p, q = root(int(comps[rows[i]])), root(int(comps[columns[j]]))
        if p != q:
            parent[p] = q
            yield int(rows[i]), int(columns[j])


def _block_matcher(threshold: int):
    def match(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s.as_py(), _U) for s in group.column("shingles")]
        side, comps = group.column("side").to_numpy(), group.column("component").to_numpy()
        ids = group.column("rep").to_numpy()
        pairs = list(_block_links(sets, np.flatnonzero(side == 0), np.flatnonzero(side == 1), comps, threshold))
        ends = [[int(min(ids[i], ids[j])) for i, j in pairs], [int(max(ids[i], ids[j])) for i, j in pairs]]
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    return match


def near_duplicates(
    docs: DataFrame, threshold: int = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, margin: float = MARGIN, m: int = REGISTERS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Two documents are linked if 100 * |A & B| >= ``threshold`` * |A | B| for their sets of ``n``-word
    shingles.  A component's id is its least doc_id; ``kept`` marks the document of that id.
    Documents without words (null, empty or blank texts) are linked with nothing.  Rows that share
    a doc_id count as one document that is linked as any of them is.  A row with a null doc_id has
    no component and is kept.  Other columns are not read; an empty table gives no rows.  ``bands`` of
    ``m / bands`` of the ``m`` registers propose pairs; estimates below ``threshold`` - 100 ``margin`` are dropped.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, ka bigint, kb bigint, regs binary, bands array<bigint>"
    signed = keep(rows.mapInArrow(_signer(n, m, bands), schema), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = keep(usable.groupBy("ka", "kb").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["ka", "kb", "doc_id"])
    reps = keep(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "regs", "bands"), "representatives")

    placed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = placed.groupBy("band", "key").agg(
        F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("members")
    )
    buckets = buckets.where("first <> last").drop("last")
    members = keep(placed.join(buckets, ["band", "key"]), "members")

    # the texts are read once more, for the sets of all candidates; both rounds and the blocks join those
    candidates = keep(members.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    texts = rows.join(candidates, "doc_id", "left_semi")
    sets = keep(texts.mapInArrow(_set_maker(n), "doc_id bigint, shingles binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b")
        likely = likely.mapInArrow(_estimator(m, threshold / 100 - margin), "a bigint, b bigint")
        likely = keep(likely.distinct(), "likely")
        ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id")))
        own = sets.join(ids.distinct(), "doc_id", "left_semi")
        named = lambda x: own.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
        both = likely.join(named("a"), "a").join(named("b"), "b")
        return keep(both.mapInArrow(_confirmer(threshold), "a bigint, b bigint").distinct(), "links")

    first = members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(first)
    known = components(links)

    labelled = members.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rep"))
    spread = labelled.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = spread.where("low <> high").select("band", "key")
    labelled = keep(labelled.join(open_, ["band", "key"]), "open")

    item = F.struct("rep", "component")
    small = labelled.where(F.col("members") <= SMALL).groupBy("band", "key").agg(F.collect_list(item).alias("all"))
    pairs = small.select(
        F.explode(
            F.flatten(
                F.transform(
                    "all",
                    lambda x: F.transform(
                        F.filter("all", lambda y: (y["rep"] > x["rep"]) & (y["component"] != x["component"])),
                        lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")),
                    ),
                )
            )
        ).alias("p")
    ).select("p.a", "p.b")
    more = confirmed(pairs.distinct().join(first, ["a", "b"], "left_anti"))

    large = labelled.where(F.col("members") > SMALL)
    counts = large.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("band", "key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.sum("n").alias("all"),
        F.max("n").alias("most"),
    )
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    large = large.join(main.select("band", "key", "main", blocks(F.col("all")).alias("na"), blocks(F.col("all") - F.col("most")).alias("nr")), ["band", "key"])
    large = large.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    place = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["band", "key", "rep", "component", "shingles"]
    rest = large.where(F.col("component") != F.col("main")).select(*columns, F.lit(0).alias("side"), place("nr").alias("rb"), every("na").alias("ab"))
    each = large.select(*columns, F.lit(1).alias("side"), every("nr").alias("rb"), place("na").alias("ab"))
    blocked = rest.unionByName(each).groupBy("band", "key", "rb", "ab")
    across = keep(blocked.applyInArrow(_block_matcher(threshold), "a bigint, b bigint").distinct(), "links")

    final = components(links.unionByName(more).unionByName(across))
    named = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = keep(named.select("ka", "kb", F.coalesce("component", "rep").alias("component")), "named")
    out = signed.select("doc_id", "n_shingles", "ka", "kb").join(named, ["ka", "kb"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
