"""Single-linkage clusters of token bags: a maximum spanning forest over cosine similarities, cut at k clusters.

Equal bags are one node.  Two bags of similarity ``floor`` or more share one of their rarest tokens (those before the rest
of a bag weighs less than ``floor``), so bags meet on those tokens only.  No pairs are emitted: each group of bags hands on
its own spanning forest, and the forest of all pairs is the forest of the groups' forests.  Boruvka rounds find it: each
component takes its best edge out, components that chose each other merge, until no edge leads out.

Only the forest's weakest edges are cut, so what lies together above them needs no forest.  Where ``k`` bags have no
neighbour above a similarity, the cut is not above it either: bags that short bags (hubs) link more closely than that are
one node, the core.  Each bag outside it meets the core once, for its best edge, and the others outside by groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.event_log import keep

#: Weights are whole multiples of 1 / UNIT, so similarities are exact integers in units of 1 / UNIT^2.
UNIT = 1 << 20
#: Bags of a block; two blocks meet in a task.
BLOCK = 512
#: Bags that are probed for their nearest neighbour (8 a cluster, so many at least and at most), hubs, and a hub's most words.
PROBES, MOST_PROBES, HUBS, HUB_WORDS = 64, 4096, 1 << 16, 8
#: Words of the bags outside the core that are broadcast at once, and the most broadcasts; beyond, all bags meet by groups.
WORDS, PARTS = 2_000_000, 16
#: Bags of a batch and bags that it meets at once; a bag's heaviest words whose pairs are looked up in the hubs.
ROWS, COLUMNS, HEAVIEST = 4096, 1024, 16
#: Samples of the core, a 16th and a 4th, that bags outside meet first if they are more than ``COLUMNS``.
SHARES = (16, 4)
_EDGE = "a string, b string, sim bigint"


def vectors(bags: DataFrame, least: int = 2) -> DataFrame:
    """``id, words, weights, n_words`` of ``bags(id, bag, n)``: tf-idf of length 1 of the tokens that ``least`` rows hold,
    rarest token first.

    A bag stands for ``n`` rows.  idf is ln((1 + rows) / (1 + rows with the token)) + 1.  Bags whose tokens are all rare
    give no row.
    """
    known = bags.select("n", F.explode(F.array_distinct("bag")).alias("word")).groupBy("word").agg(F.sum("n").alias("df")).where(F.col("df") >= least)
    tf = bags.repartition("id").select("id", F.explode("bag").alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))
    total = bags.agg(F.sum("n").alias("rows"))  # one row
    idf = F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1
    w = tf.join(known, "word").crossJoin(F.broadcast(total)).select("id", F.struct("df", "word", (F.col("tf") * idf).alias("w")).alias("t"))
    bag = w.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("b"))
    length = F.sqrt(F.aggregate("b", F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))
    weights = F.transform("b", lambda t: F.round(t["w"] / F.col("length") * UNIT).cast("bigint"))
    return bag.withColumn("length", length).select("id", F.col("b.word").alias("words"), weights.alias("weights"), F.size("b").alias("n_words"))


def _rarest(floor: float) -> Column:
    """Tokens before the rest of a bag weighs less than ``floor`` (a thousandth less, for rounded weights)."""
    limit = int((floor * UNIT * 0.999) ** 2)
    total = F.aggregate("weights", F.lit(0).cast("bigint"), lambda s, w: s + w * w)
    start = F.struct(total.alias("rest"), F.lit(0).alias("n"))
    step = lambda s, w: F.struct((s["rest"] - w * w).alias("rest"), (s["n"] + F.when(s["rest"] >= limit, 1).otherwise(0)).alias("n"))
    return F.slice("words", 1, F.greatest(F.aggregate("weights", start, step)["n"], F.lit(1)))


def _forest(sims: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the maximum spanning forest of a similarity matrix (negative: no edge); ties to the smallest pair."""
    n = len(sims)
    best, parent, free, out = np.full(n, -1.0), np.full(n, -1), np.ones(n, bool), []
    pair = lambda v: (min(v, parent[v]), max(v, parent[v]))
    for _ in range(n):
        top = best[free].max()
        ties = np.flatnonzero(free & (best == top))
        v = ties[0] if top < 0 else min(ties, key=pair)
        if top >= 0:
            out.append(pair(v))
        free[v] = False
        row = sims[v]
        for u in np.flatnonzero(free & (row >= 0) & (row >= best)):
            if row[u] > best[u] or (min(v, u), max(v, u)) < pair(u):
                best[u], parent[u] = row[u], v
    return out


def _group(floor: int):
    def forest(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("id").sort_values("id", ignore_index=True)
        words = {w: i for i, w in enumerate(sorted(set().union(*frame["words"])))}
        m = np.zeros((len(frame), len(words)))
        for row, (ws, vs) in enumerate(zip(frame["words"], frame["weights"], strict=True)):
            m[row, [words[w] for w in ws]] = vs
        sims = m @ m.T  # exact: all sums are whole numbers below 2^53
        sims[sims < floor] = -1
        np.fill_diagonal(sims, -1)
        ids = frame["id"].to_numpy()
        return pd.DataFrame([(ids[i], ids[j], int(sims[i, j])) for i, j in _forest(sims)], columns=["a", "b", "sim"])

    return forest


def links(nodes: DataFrame, floor: float) -> DataFrame:
    """``a, b, sim`` (a < b): a spanning forest of each group of nodes that share a rare token."""
    seen = nodes.select("*", F.explode(_rarest(floor)).alias("token"))
    sizes = seen.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    placed = seen.join(sizes, "token").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    placed = placed.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    grouped = placed.select("token", "lo", "hi", "id", "words", "weights").groupBy("token", "lo", "hi")
    return grouped.applyInPandas(_group(int(floor * UNIT * UNIT)), _EDGE).distinct()


class _Index:
    """A table of bags as columns: per chunk of ``COLUMNS`` bags the places and weights of each word."""

    def __init__(self, bags: pa.Table):
        self.ids, words = bags["id"].combine_chunks(), bags["words"].combine_chunks()
        flat = pc.list_flatten(words)
        self.words = pc.unique(flat)
        word = pc.index_in(flat, value_set=self.words).to_numpy(zero_copy_only=False)
        col, weight = pc.list_parent_indices(words).to_numpy(zero_copy_only=False), pc.list_flatten(bags["weights"].combine_chunks()).to_numpy(zero_copy_only=False)
        self.chunks = []
        for start in range(0, len(self.ids), COLUMNS):
            here = np.flatnonzero((col >= start) & (col < start + COLUMNS))
            here = here[np.argsort(word[here], kind="stable")]
            at = np.searchsorted(word[here], np.arange(len(self.words) + 1))
            self.chunks.append((start, min(COLUMNS, len(self.ids) - start), at, col[here] - start, weight[here].astype(float)))

    def sims(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """Where each chunk begins, and the similarities of its bags (rows) and the batch's (columns), until the next one."""
        word, row, weight = _entries(batch, self.words)
        order = np.argsort(word, kind="stable")
        word, row, weight = word[order], row[order], weight[order].astype(float)
        known, first = np.unique(word, return_index=True)
        ends, width = np.append(first[1:], len(word)), batch.num_rows
        buffer = np.empty(COLUMNS * width)
        for start, n, at, col, other in self.chunks:
            out = buffer[: n * width]
            out.fill(0)
            for w, i, j in zip(known, first, ends, strict=True):
                x, y = at[w], at[w + 1]
                if x < y:
                    out[(col[x:y, None] * width + row[i:j]).ravel()] += (other[x:y, None] * weight[i:j]).ravel()  # exact: whole numbers below 2^53
            yield start, out.reshape(n, width)


def _entries(batch: pa.RecordBatch, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word (its place in ``words``), row and weight of each word of a batch that ``words`` holds."""
    lists = batch.column("words")
    word = pc.index_in(pc.list_flatten(lists), value_set=words)
    here = pc.is_valid(word).to_numpy(zero_copy_only=False)
    row, weight = pc.list_parent_indices(lists), pc.list_flatten(batch.column("weights"))
    return pc.drop_null(word).to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)[here], weight.to_numpy(zero_copy_only=False)[here]


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROWS`` bags at most, least id first."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part.take(pc.sort_indices(part.column("id")))


def _nearest(shared, outside: bool):
    """``r, x, sim``: the bag most similar to each one of the index, of equal ones the least; none that is in the index if ``outside``."""

    def search(batches):
        index = shared.value
        best, who = np.zeros(len(index.ids), np.int64), np.full(len(index.ids), None, object)
        for batch in _slices(batches):
            if outside:
                batch = batch.filter(pc.invert(pc.is_in(batch.column("id"), value_set=index.ids)))
            else:
                own = pc.index_in(batch.column("id"), value_set=index.ids).to_numpy(zero_copy_only=False)
            if not batch.num_rows:
                continue
            ids = batch.column("id")
            for start, sims in index.sims(batch):
                if not outside:
                    mine = np.flatnonzero((own >= start) & (own < start + len(sims)))
                    sims[own[mine].astype(int) - start, mine] = 0
                top = sims.argmax(1)  # the first one, of the least id
                value = sims[np.arange(len(sims)), top].astype(np.int64)
                for c in np.flatnonzero((value > 0) & (value >= best[start : start + len(value)])):
                    x = ids[top[c]].as_py()
                    if value[c] > best[start + c] or x < who[start + c]:
                        best[start + c], who[start + c] = value[c], x
        found = np.flatnonzero(best)
        columns = [index.ids.take(pa.array(found)).cast(pa.string()), pa.array(who[found], pa.string()), pa.array(best[found])]
        yield pa.RecordBatch.from_arrays(columns, ["r", "x", "sim"])

    return search


def _level(nodes: DataFrame, k: int) -> int | None:
    """A similarity that ``k`` of the bags with the lightest words don't reach with any other, or nothing if so few are known.

    Cut at ``k`` clusters, the forest keeps all edges from that similarity on: without the others, ``k`` bags are alone.
    """
    n = max(PROBES, min(8 * k, MOST_PROBES))
    probes = nodes.select("id", "words", "weights").orderBy(F.array_max("weights"), "id").limit(n).toArrow()
    if probes.num_rows < k:
        return None
    found = nodes.select("id", "words", "weights").mapInArrow(_nearest(nodes.sparkSession.sparkContext.broadcast(_Index(probes)), False), "r string, x string, sim bigint")
    near = sorted([r["sim"] for r in found.groupBy("r").agg(F.max("sim").alias("sim")).collect()])
    alone = probes.num_rows - len(near)
    return near[k - alone - 1] + 1 if k > alone else 0


def _joined(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The component of each of ``n`` nodes under edges: its least node."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, one, label[two])
        np.minimum.at(least, two, label[one])
        least = least[least]
        if (least == label).all():
            return label
        label = least


class _Hubs:
    """Short bags that are linked at ``level`` or above: the heaviest weight of each word among them, and of each pair of
    words the weights in the bag that holds both most evenly.  Each gives a bound on similarities from below."""

    def __init__(self, hubs: pa.Table, level: int):
        self.level, lists = level, hubs["words"].combine_chunks()
        flat = pc.list_flatten(lists)
        words = pc.unique(flat)
        word = pc.index_in(flat, value_set=words).to_numpy(zero_copy_only=False)
        row, weight = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(hubs["weights"].combine_chunks()).to_numpy(zero_copy_only=False)
        order = np.lexsort((row, -weight, word))
        first = order[np.searchsorted(word[order], np.arange(len(words)))]  # the heaviest one of each word
        near = weight * weight[first[word]] >= level
        component = _joined(hubs.num_rows, row[near], row[first[word[near]]])
        core = component == np.bincount(component).argmax()
        self.words, (word, row, weight) = words, (x[core[row]] for x in (word, row, weight))
        self.top = np.zeros(len(words), np.int64)
        np.maximum.at(self.top, word, weight)
        begin, size = np.unique(row, return_index=True, return_counts=True)[1:]
        pairs = []
        for i in range(HUB_WORDS - 1):
            for j in range(i + 1, HUB_WORDS):
                x = begin[size > j] + i
                pairs.append((self._key(word[x], word[x + j - i]), *self._sides(word[x], word[x + j - i], weight[x], weight[x + j - i])))
        key, p, q = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((-np.minimum(p, q), key))
        self.keys, at = np.unique(key[order], return_index=True)
        self.p, self.q = p[order][at], q[order][at]

    def _key(self, v, w):
        return np.minimum(v, w).astype(np.int64) * len(self.words) + np.maximum(v, w)

    @staticmethod
    def _sides(v, w, p, q):
        return np.where(v < w, p, q), np.where(v < w, q, p)

    def far(self, batch: pa.RecordBatch) -> np.ndarray:
        """The bags of a batch that no bound brings to ``level``; equal bags are judged alike."""
        far = np.ones(batch.num_rows, bool)
        word, row, weight = _entries(batch, self.words)
        far[row[weight * self.top[word] >= self.level]] = False
        if not len(self.keys):
            return far
        rest = far[row]
        word, row, weight = word[rest], row[rest], weight[rest]
        order = np.lexsort((word, -weight, row))
        word, row, weight = word[order], row[order], weight[order]
        rows, begin, size = np.unique(row, return_index=True, return_counts=True)
        for j in range(1, min(HEAVIEST, size.max(initial=0))):
            for i in range(j):
                at = np.flatnonzero((size > j) & far[rows])
                x, y = begin[at] + i, begin[at] + j
                key, (p, q) = self._key(word[x], word[y]), self._sides(word[x], word[y], weight[x], weight[y])
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                near = (self.keys[k] == key) & (p * self.p[k] + q * self.q[k] >= self.level)
                far[rows[at[near]]] = False
        return far


def _outside(shared):
    def search(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.far(batch)))

    return search


def _parts(outside: DataFrame) -> int:
    return -(-(outside.agg(F.sum("n_words")).first()[0] or 0) // WORDS)


def _to_core(nodes: DataFrame, outside: DataFrame, parts: int, least: int) -> DataFrame:
    """``r, x, sim``: for each node outside the most similar one of ``nodes`` in the core (of equal ones the least), if it
    reaches ``least``."""
    found = None
    for part in range(parts):
        here = outside.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        shared = nodes.sparkSession.sparkContext.broadcast(_Index(here.select("id", "words", "weights").toArrow()))
        core = nodes if parts == 1 else nodes.join(outside.select("id"), "id", "left_anti")
        best = core.select("id", "words", "weights").mapInArrow(_nearest(shared, True), "r string, x string, sim bigint")
        found = best if found is None else found.unionByName(best)
    best = found.where(F.col("sim") >= least).groupBy("r").agg(F.min(F.struct((-F.col("sim")).alias("s"), "x")).alias("m"))
    return best.select("r", "m.x", (-F.col("m.s")).alias("sim"))


def _core(nodes: DataFrame, k: int, floor: int) -> tuple[DataFrame, int] | None:
    """The nodes outside a core that lies in one cluster when cut at ``k``, kept, and their number of broadcasts; nothing if
    no core is large enough.

    Nodes outside that meet a node of the core at the level belong to it, too: a sample of the core finds most of them.
    """
    level = _level(nodes, k)
    if level is None:
        return None
    hubs = nodes.where(F.col("n_words") <= HUB_WORDS).orderBy("n_words", F.xxhash64("id"), "id").limit(HUBS).select("words", "weights").toArrow()
    if not hubs.num_rows:
        return None
    level = max(level, floor)
    shared = nodes.sparkSession.sparkContext.broadcast(_Hubs(hubs, level))
    outside = keep(nodes.mapInArrow(_outside(shared), nodes.schema), "outside")
    for share in SHARES:
        if outside.count() <= COLUMNS or (parts := _parts(outside)) > PARTS:
            break
        sample = nodes.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(share)) == 0)
        near = _to_core(sample, outside, parts, level)
        outside = keep(outside.join(near.select(F.col("r").alias("id")), "id", "left_anti"), "outside")
    parts = _parts(outside)
    return (outside, parts) if parts <= PARTS else None


def spanning_forest(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The maximum spanning forest of ``edges(a, b, sim)`` (ties to the smallest pair), and ``id, component`` (its least id)
    of ``nodes(id)``; nodes with a ``component`` of their own are joined to it before.  A round halves the components at
    least; each is written to the shared folder."""
    edges = keep(edges.where("a < b").select("a", "b", "sim"), "edges")
    own = "component" if "component" in nodes.columns else "id"
    labels = keep(nodes.select("id", F.col(own).alias("component")), "labels")
    empty = edges.where("false")
    forest = empty
    while True:
        one, two = (labels.select(F.col("id").alias(n), F.col("component").alias(f"c{n}")) for n in ("a", "b"))
        out = edges.join(one, "a").join(two, "b").where("ca <> cb")
        rank = F.struct((-F.col("sim")).alias("s"), "a", "b")
        sides = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("d")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("d"))))
        best = out.select(rank.alias("e"), sides.alias("s")).groupBy("s.c").agg(F.min(F.struct("e", "s.d")).alias("m"))
        best = keep(best.select("c", F.col("m.d").alias("d"), F.col("m.e.a").alias("a"), F.col("m.e.b").alias("b"), (-F.col("m.e.s")).alias("sim")), "best")
        if best.isEmpty():
            return forest, labels
        forest = forest.unionByName(best.select("a", "b", "sim").distinct())
        # two components that chose each other are a root: the lesser of them; all others lead there
        back = best.select(F.col("c").alias("d"), F.col("d").alias("back"))
        root = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d"))
        jumps = keep(best.join(back, "d").select("c", root.alias("to")), "jumps")
        while True:
            beyond = jumps.select(F.col("c").alias("to"), F.col("to").alias("beyond"))
            new = keep(jumps.join(beyond, "to").select("c", F.col("beyond").alias("to"), (F.col("to") != F.col("beyond")).alias("moved")), "jumps")
            jumps = new.select("c", "to")
            if new.where("moved").isEmpty():
                break
        moved = labels.join(jumps.withColumnRenamed("c", "component"), "component", "left")
        moved = moved.select("id", F.coalesce("to", "component").alias("root"))
        least = moved.groupBy("root").agg(F.min("id").alias("component"))
        labels = keep(moved.join(least, "root").select("id", "component"), "labels")


def linked_clusters(df: DataFrame, name: str, tokens: str, k: int, floor: float = 0.1, least: int = 2) -> DataFrame:
    """``df`` and ``cluster``: single linkage by cosine of tf-idf, cut where ``k`` clusters are left.

    ``name`` is a column of distinct ids; a cluster is named by its least id (as text).  Bags less similar than ``floor``
    (above 0) are never linked, so more than ``k`` clusters stay where the forest has more trees.  Rows without a token that
    ``least`` rows hold, or without an id, get a null cluster.  Ties go to the smallest pair of ids.
    """
    known = F.array_sort(F.filter(tokens, lambda t: t.isNotNull()))
    bag = F.when(F.col(name).isNotNull(), F.coalesce(known, F.array().cast(df.schema[tokens].dataType)))
    df = keep(df, "rows")
    rows = df.withColumn("_bag", bag).withColumn("_hash", F.xxhash64("_bag"))
    bags = rows.where("_bag is not null").groupBy("_hash", F.col("_bag").alias("bag")).agg(F.min(F.col(name).cast("string")).alias("id"), F.count("*").alias("n"))
    bags = keep(bags, "bags")
    vs = vectors(bags, least)
    same = Window.partitionBy(F.xxhash64("words", "weights"), "words", "weights")
    vs = keep(vs.withColumn("node", F.min("id").over(same)), "vectors")
    nodes = vs.where("id = node").drop("node")

    core, least_sim, start = None, int(floor * UNIT * UNIT), nodes.select("id")
    if found := _core(nodes, k, least_sim):
        outside, parts = found
        core = nodes.join(outside.select("id"), "id", "left_anti").agg(F.min("id")).first()[0]
    if core is None:
        edges = links(nodes, floor)
    else:
        best = nodes.sparkSession.createDataFrame([], _EDGE)
        if parts:
            best = _to_core(nodes, outside, parts, least_sim)
            best = keep(best.select(F.least("r", "x").alias("a"), F.greatest("r", "x").alias("b"), "sim"), "best")
        edges = links(outside, floor).unionByName(best)
        met = best.select(F.explode(F.array("a", "b")).alias("id")).unionByName(nodes.where(F.col("id") == core).select("id"))
        inside = met.join(outside.select("id"), "id", "left_anti").distinct().select("id", F.lit(core).alias("component"))
        start = keep(outside.select("id", F.col("id").alias("component")).unionByName(inside), "start")

    forest, trees = spanning_forest(edges, start)
    forest = keep(forest, "forest")
    cut = k - trees.select("component").distinct().count()
    if cut > 0:
        weakest = forest.orderBy("sim", F.desc("a"), F.desc("b")).limit(cut)  # fewer than k edges
        kept = forest.join(F.broadcast(weakest.select("a", "b")), ["a", "b"], "left_anti")
        trees = spanning_forest(kept, start)[1]
    found = vs.join(trees.select(F.col("id").alias("node"), "component"), "node", "left")
    if core is not None:
        found = found.withColumn("component", F.coalesce("component", F.lit(trees.where(F.col("id") == core).first()["component"])))
    found = bags.join(found.select("id", "component"), "id").select(F.col("_hash").alias("_h"), F.col("bag").alias("_b"), F.col("component").alias("cluster"))
    return rows.join(found, (F.col("_hash") == F.col("_h")) & (F.col("_bag") == F.col("_b")), "left").drop("_hash", "_bag", "_h", "_b")
