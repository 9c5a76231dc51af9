"""Near-duplicate embeddings: small-world graphs per shard, every pair of shards searched, cosines verified.

Equal vectors of a label are one class.  The classes of a label are dealt into shards of bounded size by a hash; each
shard gets a graph, and the vectors of each shard are searched in the graph of every other one and of their own (a pair
of shards once, for both sides).  A task returns sums of links a vector and a spanning forest of the links it found, so
that neither all pairs nor a whole label come together anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .graph import components
from .smallworld import DEGREE, audited_links, build, levels, unit

COSINE = 0.93
#: Classes of a shard.
CAPACITY = 4096
#: How far below the threshold single-precision similarities are verified in double precision.
SLACK = 1e-5

_KEY = ["label", "dim", "shard"]
_GRAPH = "label string, dim int, shard int, shards int, ids binary, copies binary, vectors binary, layers array<binary>"


def usable(vector: Column) -> Column:
    """Whether a vector has a cosine: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _graphs(table: pa.Table) -> pa.Table:
    ids = table["class"].to_numpy()
    dim = table["dim"][0].as_py()
    raw = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    level = levels(ids)
    order = np.lexsort((ids, -level))
    ids, raw, level = ids[order], raw[order].astype(np.float64), level[order]
    layers = build(unit(raw).astype(np.float32), level)
    row = {c: table[c][:1] for c in (*_KEY, "shards")}
    row |= {"ids": [ids.tobytes()], "copies": [table["copies"].to_numpy()[order].tobytes()], "vectors": [raw.tobytes()]}
    row["layers"] = pa.array([[x.astype(np.int32).tobytes() for x in layers]], pa.list_(pa.binary()))
    return pa.table(row)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes can reach by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _searcher(least: float):
    def search(table: pa.Table) -> pa.Table:
        row = {r["role"]: r for r in table.to_pylist()}
        side = {}
        for role, r in row.items():
            raw = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
            side[role] = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64), raw
        ids, copies, raw = side["graph"]
        q_ids, q_copies, q_raw = side.get("queries", side["graph"])
        own = "queries" not in side
        layers = [np.frombuffer(x, np.int32).reshape(-1, DEGREE * (1 if i else 2)).astype(np.int64) for i, x in enumerate(row["graph"]["layers"])]
        x, q = unit(raw), unit(q_raw)
        a, b = audited_links(x.astype(np.float32), layers, q.astype(np.float32), least - SLACK)
        if own:  # a link found from either end counts for both
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        pairs = np.unique(a * np.int64(len(x)) + b)
        a, b = pairs // len(x), pairs % len(x)
        sure = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], x[b[i : i + 65536]]) >= least for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[sure], b[sure]
        count = np.zeros(len(x), np.int64), np.zeros(len(q), np.int64)
        np.add.at(count[0], b, q_copies[a])
        np.add.at(count[0] if own else count[1], a, copies[b])
        nodes = ids if own else np.concatenate([ids, q_ids])
        label = _forest(a if own else a + len(ids), b, len(nodes))
        tied = np.flatnonzero(label != np.arange(len(nodes)))
        found = [(ids, count[0])] if own else [(ids, count[0]), (q_ids, count[1])]
        out_a = [i[n > 0] for i, n in found] + [nodes[label[tied]]]
        out_n = [n[n > 0] for _, n in found]
        sums = sum(map(len, out_n))
        far = pa.array([None] * sums + nodes[tied].tolist(), pa.int64())
        return pa.table({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": far, "n": pa.array([*np.concatenate(out_n).tolist(), *[None] * len(tied)], pa.int64())})

    return search


def near_vectors(vectors: DataFrame, least: float = COSINE, capacity: int = CAPACITY) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, label, embedding)``.

    Rows of equal labels are linked when their cosine, in double precision, is ``least`` or more.  Null, empty and zero
    vectors, those with null or non-finite components, and rows without a label or an id link with nothing: no links,
    their own component, kept (without an id: neither component nor kept).  Vectors of different lengths don't link.
    Each repeated row counts as a vector, with one component for an id; an empty table gives no rows; extra columns of
    any name are left out.  The search is approximate (see ``audited_links``); what it finds is exact.
    """
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    classes = rows.where(ok).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = keep(classes.withColumns({"dim": F.size("vector"), "class": F.monotonically_increasing_id()}), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / capacity).cast("int").alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("class"), F.col("shards")).cast("int"))
    graphs = keep(dealt.groupBy(*_KEY).applyInArrow(_graphs, _GRAPH), "vector-graphs")
    # a pair of shards (shard <= other): the vectors of the first are searched in the graph of the second
    first = graphs.withColumn("other", F.explode(F.sequence("shard", F.col("shards") - 1))).where("other > shard")
    first = first.withColumns({"role": F.lit("queries"), "layers": F.lit(None).cast("array<binary>")})
    second = graphs.withColumn("other", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.lit(0), "other"))).withColumn("role", F.lit("graph"))
    pairs = first.unionByName(second).groupBy("label", "dim", "shard", "other")
    found = keep(pairs.applyInArrow(_searcher(least), "a bigint, b bigint, n bigint"), "vector-links")
    links = found.where("n is not null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    ids = keep(rows.where(ok).join(classes.select("label", "vector", "class", "copies"), ["label", "vector"]).select("vec_id", "class", "copies"), "vector-ids")
    # an id with several vectors ties their classes
    each = ids.select("vec_id", "class").distinct()
    several = each.groupBy("vec_id").agg(F.min("class").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
    tied = each.join(several, "vec_id").select(F.col("class").alias("a"), "b")
    parts = components(found.where("b is not null").select("a", "b").unionByName(tied)).withColumnRenamed("node", "class")
    least_ids = parts.join(classes.select("class", "rep"), "class").groupBy("component").agg(F.min("rep").alias("least"))
    named = classes.select("class", "rep").join(parts, "class", "left").join(least_ids, "component", "left")
    named = named.select("class", F.coalesce("least", "rep").alias("component_id"))
    ids = ids.join(named.join(links, "class", "left"), "class")
    ids = ids.select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"))
    if_tied = ids.groupBy("vec_id").agg(F.min("component_id").alias("other"))
    alone = alone.join(if_tied, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component_id", "other", "vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return ids.unionByName(alone).withColumn("kept", kept)
