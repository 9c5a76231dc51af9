"""Collocations: phrases whose words stand together more often than their parts would make them.

A pointer to each word of a piece stands for the suffix that begins there.  Pointers of a chunk of text whose leading
words are equal are added up, dealt to routes by a hash of these words, and packed: one binary cell a chunk, language
and route.  A route's pointers are sorted by a multikey three-way quicksort, word by word; the weight of an equal
partition is a count, and partitions that weigh too little are abandoned.  All pointers of a phrase lie in one route,
and no hot word or pair brings all its pointers there.

The first pass over the texts sorts to two words; each later one goes a word deeper, for pointers only whose leading
and following words both belong to partitions that weren't abandoned.  Those are kept as a bit each, by a hash of the
words, in a table of bounded size; an accidental bit lets a pointer through that the sort then abandons.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .hashing import pair

#: Words of a phrase at most, and the least count of one.
DEPTH, LEAST = 3, 10
#: Phrases a language, and the percentage of a phrase's count from which a longer one takes its place.
MOST, SHARE = 2000, 50
#: Bytes of text that are sorted together before they are dealt out.
CHUNK = 8_000_000

#: Bits a frequent phrase in the table that later passes look at, and the most bits of all (64 MB).
SPARSE, MOST_BITS = 16, 1 << 29

_BREAK = b"\xff"  # no byte of UTF-8 text
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The ids of the words of all texts, 0 at the ends of pieces; and the words from id 1 on, each with a space behind it."""
    joined = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" " + _BREAK + b" ") + b" "
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).astype(np.int32) + np.int32(1)
    offsets = np.concatenate([np.zeros(1, np.int32), ends])
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    coded = words.dictionary_encode()
    ids, own = coded.indices.to_numpy(), coded.dictionary
    known = own.to_pylist()
    number = np.ones(len(known), np.int64)
    for special, mark in ((b" ", -1), (_BREAK + b" ", 0)):
        if special in known[:1000] or special in known:
            number[known.index(special)] = mark
    real = number > 0
    number[real] = np.arange(1, real.sum() + 1)
    ids = number[ids]
    return ids[ids >= 0], own.filter(pa.array(real))


def hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, at its id."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, [b"", *words.to_pylist()]), np.uint64, len(words) + 1)


def led_by(h: np.ndarray) -> np.ndarray:
    """A hash of rows of word hashes."""
    mixed = h[:, 0]
    for d in range(1, h.shape[1]):
        mixed = pair(mixed, h[:, d], d)
    return mixed


def suffixes(ids: np.ndarray, depths: range, passes=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth the distinct sequences of so many words of one piece (rows of ids), and their counts.

    ``passes(rows of ids)`` says which sequences one word shorter are worth going on from.
    """
    base = np.int64(ids.max(initial=0) + 1)
    for depth in depths:
        n = max(0, len(ids) - depth + 1)
        full = ids[:n] > 0
        for d in range(1, depth):
            full &= ids[d : n + d] > 0
        at = np.flatnonzero(full)
        if passes and depth > 1:
            row = lambda at: np.stack([ids[at + d] for d in range(depth - 1)], 1)  # noqa: E731, B023
            at = at[passes(row(at))]
            at = at[passes(row(at + 1))]
        if float(base) ** depth < 2**62:
            code = np.zeros(len(at), np.int64)
            for d in range(depth):
                code = code * base + ids[at + d]
            code.sort()
            first = np.flatnonzero(np.diff(code, prepend=-1))
            counts = np.diff(np.append(first, len(code)))
            code, columns = code[first], []
            for _ in range(depth):
                columns.insert(0, code % base)
                code = code // base
            yield np.stack(columns, 1) if columns else np.zeros((0, depth), np.int64), counts
        else:
            rows, counts = np.unique(np.stack([ids[at + d] for d in range(depth)], 1), axis=0, return_counts=True)
            yield rows, counts


def frequent(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct key (an index) whose weights come to ``least`` or more, and that sum.

    A multikey three-way quicksort of pointers to the rows of ``keys``, all partitions in step: each is parted by the
    median of three of its values at its depth; the equal part goes on at the next depth, and what weighs less than
    ``least`` is abandoned.
    """
    width = keys.shape[1]
    rows = np.arange(len(keys))
    starts, depths = np.zeros(1 if len(keys) else 0, np.int64), np.zeros(1 if len(keys) else 0, np.int64)
    found, sums = [], []
    while len(starts):
        sizes = np.diff(np.append(starts, len(rows)))
        value = lambda at: keys[rows[at], depths]
        three = np.stack([value(starts), value(starts + sizes // 2), value(starts + sizes - 1)])
        pivot = np.sort(three, axis=0)[1]
        part = np.repeat(np.arange(len(starts)), sizes)
        own = keys[rows, depths[part]]
        side = part * 3 + (own >= pivot[part]).astype(np.int64) + (own > pivot[part])
        order = np.argsort(side, kind="stable")
        rows, side = rows[order], side[order]
        heavy = np.bincount(side, weights[rows], 3 * len(starts)).astype(np.int64)
        n = np.bincount(side, minlength=3 * len(starts))
        deeper = np.repeat(depths, 3)
        deeper[1::3] += 1
        live = (heavy >= least) & (n > 0)
        done = live & (deeper == width)
        first = np.cumsum(n) - n
        found.append(rows[first[done]])
        sums.append(heavy[done])
        going = live & ~done
        rows = rows[going[side]]
        starts, depths = (np.cumsum(n[going]) - n[going]), deeper[going]
    none = np.zeros(0, np.int64)
    return np.concatenate(found or [none]), np.concatenate(sums or [none])


def _packed(keys: np.ndarray, weights: np.ndarray, route: np.ndarray, words: pa.Array, codec) -> Iterator[tuple[int, bytes]]:
    """(route, cell) of the rows of ``keys``, of which each cell holds the words that it needs."""
    order = np.argsort(route, kind="stable")
    keys, weights, route = keys[order].astype(np.int64), weights[order].astype(np.uint32), route[order]
    base = np.int64(len(words) + 1)
    pairs, local = np.unique((route[:, None] * base + keys).ravel(), return_inverse=True)
    used, of = pairs % base, pairs // base
    text = words.take(pa.array(np.maximum(used - 1, 0)))
    _, offsets, data = text.buffers()
    offsets, data = np.frombuffer(offsets, np.int32)[: len(text) + 1], memoryview(data)
    local = local.reshape(keys.shape)
    for r in np.unique(route).tolist():
        a, b = np.searchsorted(route, [r, r + 1])
        p, q = np.searchsorted(of, [r, r + 1])
        head = np.array([b - a, keys.shape[1]], np.int64).tobytes()
        body = (local[a:b] - p).astype(np.uint32).tobytes() + weights[a:b].tobytes()
        yield r, codec.compress(head + body + bytes(data[offsets[p] : offsets[q]]))


def _unpack(cell: bytes, codec, seen: dict[bytes, int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    data = codec.decompress(cell)
    n, width = np.frombuffer(data, np.int64, 2).tolist()
    local = np.frombuffer(data, np.uint32, n * width, 16).reshape(n, width)
    weights = np.frombuffer(data, np.uint32, n, 16 + 4 * n * width)
    ids = np.fromiter(map(seen.__getitem__, data[16 + 4 * n * (width + 1) : -1].split(b" ")), np.int64)
    keys = np.zeros((n, depth), np.int64)
    keys[:, :width] = ids[local]
    return keys, weights.astype(np.int64)


def _in_table(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(table) - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    held, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held[lang].append(text)
            size += len(text)
            if size >= most:
                yield from held.items()
                held, size = defaultdict(list), 0
    yield from held.items()


def _dealer(depths: range, routes: int, chunk: int, table=None):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=1)
        for lang, texts in _chunks(batches, chunk):
            ids, words = word_ids(texts)
            h = hashes(words)
            salt = np.uint64(xxhash.xxh3_64_intdigest(lang))
            passes = table and (lambda rows: _in_table(led_by(h[rows]) ^ salt, table.value))  # noqa: B023
            cells = []
            for keys, weights in suffixes(ids, depths, passes):
                if len(keys):
                    route = ((led_by(h[keys]) >> np.uint64(20)) % np.uint64(routes)).astype(np.int64)
                    cells += _packed(keys, weights, route, words, codec)
            for i in range(0, len(cells), 512):
                r, c = zip(*cells[i : i + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array([lang] * len(r), pa.string()), pa.array(c, pa.binary())], ["route", "lang", "cell"])

    return deal


def _counter(depth: int, least: int):
    def count_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        own, seen, parts, size = None, {}, [], 0

        def compact():
            keys, weights = np.concatenate([k for k, _ in parts]), np.concatenate([w for _, w in parts])
            order, sums = frequent(keys, weights, 1)
            return [(keys[order], sums)], len(order)

        def result():
            keys, weights = np.concatenate([k for k, _ in parts]), np.concatenate([w for _, w in parts])
            words = [b"", *seen]
            n = int(weights[keys[:, 1:].sum(axis=1) == 0].sum()) if depth > 1 else int(weights.sum())
            order, sums = frequent(keys, weights, least)
            phrases = [b" ".join([words[i] for i in row if i]).decode() for row in keys[order].tolist()]
            depths = (keys[order] > 0).sum(axis=1)
            columns = [pa.array([own[0]] * (len(phrases) + 1)), pa.array([*depths.tolist(), 0], pa.int32()), pa.array([*phrases, None], pa.string()), pa.array([*sums.tolist(), n], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "n"])

        for batch in batches:
            for lang, route, cell in zip(*[batch.column(c).to_pylist() for c in ("lang", "route", "cell")], strict=True):
                if own != (lang, route):
                    if parts:
                        yield result()
                    own, seen, parts, size = (lang, route), defaultdict(count(1).__next__), [], 0
                parts.append(_unpack(cell, codec, seen, depth))
                size += len(parts[-1][1])
                if size > 2_000_000:  # equal keys of many chunks are added up before more are read
                    parts, held = compact()
                    size = min(held, 1_500_000)
        if parts:
            yield result()

    return count_


def _table(phrases: DataFrame):
    """A bit for each of the phrases, broadcast: built in parts of 8 KB, of which there is a bounded number."""
    n = phrases.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (SPARSE * n).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()
            if texts:
                h = np.array([[xxhash.xxh3_64_intdigest(w + b" ") for w in t.encode().split(b" ")] for t in texts], np.uint64)
                salt = np.array([xxhash.xxh3_64_intdigest(x) for x in langs], np.uint64)
                at = ((led_by(h) ^ salt) & np.uint64(bits - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 16, pa.int32()), pa.array(at & 65535, pa.int32())], ["part", "at"])

    def build(group: pa.Table) -> pa.Table:
        own = np.zeros(65536, np.uint8)
        own[group["at"].to_numpy()] = 1
        return pa.table({"part": group["part"][:1], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    parts = phrases.select("lang", "phrase").mapInArrow(place, "part int, at int").groupBy("part").applyInArrow(build, "part int, bits binary").collect()
    table = np.zeros(bits // 8, np.uint8)
    for p in parts:
        table[p["part"] * 8192 : (p["part"] + 1) * 8192] = np.frombuffer(p["bits"], np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(table)


def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """``lang, words, phrase, n``: phrases of 1 to ``depth`` words found ``least`` times or more, and per route of a
    language a row with ``words`` 0 and its number of word occurrences."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")

    def one_pass(depths: range, table=None) -> DataFrame:
        dealt = d.mapInArrow(_dealer(depths, 2 * parts, chunk, table), "route int, lang string, cell binary")
        routed = dealt.repartition(parts, "lang", "route").sortWithinPartitions("lang", "route")
        return keep(routed.mapInArrow(_counter(depths[-1], least), "lang string, words int, phrase string, n bigint"), "phrases")

    out = last = one_pass(range(1, min(depth, 2) + 1))
    for n in range(3, depth + 1):
        last = one_pass(range(n, n + 1), _table(last.where(F.col("words") == n - 1)))
        out = out.unionByName(last.where("words > 0"))
    return out


def cohesion(a: str, left: str, right: str) -> Column:
    """floor(10^6 a a / (l r)) of three counts up to 10^15, exactly."""
    return F.expr(f"(1000000BD * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, most: int = MOST, share: int = SHARE, chunk: int = CHUNK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``most`` phrases of two words or more.

    The score of a phrase is that of its weakest cut into two parts, floor(10^6 a a / (l r)), exact in decimals.  A
    phrase goes if a longer candidate that holds it has ``share`` percent of its count or more.  Null texts have no
    words and a null language is ``und``; texts of any length are read whole, repeated rows count each, ties are broken
    by count and phrase; an empty table gives no rows; extra columns of any name are left out.
    """
    f = phrase_counts(docs.select("lang", "text"), depth, least, chunk)
    total = f.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    f = f.where("words > 0")
    c = f.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cut = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    text = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cut = cut.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("first"), text(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    part = lambda name, n: f.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    worst = F.min(F.struct(cohesion("a", "l", "r").alias("score"), "k", "l", "r")).alias("x")
    scored = cut.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    inner = c.where(F.size("w") > 2).withColumn("m", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    scored = scored.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a").drop("longer")

    order = (F.desc("score"), F.desc("a"), "phrase")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))  # a language may hold most phrases: its first ones of each part come first
    best = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
