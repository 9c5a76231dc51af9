"""Hard negatives, near vectors and the graph below them against plain Python."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tests.oracle import connect, differences
from tracework.llm import queries, sql
from tracework.llm import smallworld as W
from tracework.llm.negatives import Shard, codebook, hard_negatives, negatives_in, positives_in, relabelled
from tracework.llm.vectordup import near_vectors

SCHEMA = "vec_id bigint, label int, embedding array<float>"
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_collocations", "op13_near_vectors"])
def test_query_equals_its_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), connect(SF), sql.oracle_sql()[name]) == []


def groups(seed=1, n=300, dim=8, labels=3):
    """Vectors around centres, some copied, in a few labels."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.2, 0.6], (n, 1))
    x[n // 2 : n // 2 + 20] = x[:20]
    return [(i, int(rng.integers(0, labels)), [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


def fine(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def plain_links(rows, least=0.93):
    good = [(i, lab, np.array(v, float)) for i, lab, v in rows if i is not None and lab is not None and fine(v) and any(v)]
    links, near = defaultdict(int), defaultdict(set)
    for p, (i, lab, x) in enumerate(good):
        for q, (j, other, y) in enumerate(good):
            if p != q and lab == other and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                links[p] += 1
                near[i].add(j)
    low = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low[i] = min(seen)
    out = [(i, links[p], low[i], low[i] == i) for p, (i, _, _) in enumerate(good)]
    bad = [r for r in rows if r[0] is None or r[1] is None or not (fine(r[2]) and any(r[2]))]
    return sorted(out + [(i, 0, low.get(i), i is not None and low.get(i) == i) for i, _, _ in bad], key=repr)


ODD = [
    (900, None, [1.0] * 8), (901, 0, None), (902, 0, [0.0] * 8), (903, 0, [float("nan")] * 8), (904, 1, [float("inf")] * 8), (905, 1, [None] * 8),
    (906, 1, []), (None, 1, [1.0] * 8), (907, 1, [2.0] * 8), (907, 1, [2.0] * 8), (908, 1, [4.0] * 8), (909, 2, [1.0] * 3), (910, 2, [1.0] * 3), (0, 2, [5.0] * 3),
]


@pytest.mark.parametrize("capacity", [4096, 37])
def test_near_vectors(spark, capacity):
    rows = groups() + ODD
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", rep string, shard int")
    assert sorted(map(tuple, near_vectors(d, capacity=capacity).collect()), key=repr) == plain_links(rows)


def test_near_vectors_of_nothing(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert near_vectors(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == [(1, 0, 1, True)]


def plain_negatives(rows, every=50, top=5, per=3):
    best = {}
    for i, lab, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and fine(r[2]) and len(r[2]) == 8), key=lambda r: (r[0], r[1], r[2])):
        best.setdefault(i, (lab, [math.floor(256 * c) for c in v]))
    out = []
    for a, (lab, q) in best.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:top]:
            inside = [(t, i) for t, i, other in scored if other != lab and 50 * -s <= 100 * -t <= 95 * -s][:per]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize(("capacity", "block"), [(16_384, 512), (40, 4)])
def test_hard_negatives(spark, capacity, block):
    rows = groups(2, 600) + [(i, lab, v) for i, lab, v in ODD if i != 0] + groups(2, 600)[:5]  # repeated rows
    d = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", x int")
    got = hard_negatives(d, every=10, capacity=capacity, block=block)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives(spark.createDataFrame([(1, 1, [1.0])], SCHEMA)).collect() == []
    assert relabelled(spark.createDataFrame([(7, 9, [1.0]), (8, 9, [1.0]), (0, None, None)], SCHEMA)).select("vec_id", "label").collect() == [(7, 0), (8, 9), (0, None)]


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [1e6 + 8 * i, -3e5 * (i % 3), 5.0, 0.0, 1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    rows = [(i, lab, [float(np.float32(c)) for c in v]) for i, lab, v in rows]
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), every=10).collect())) == plain_negatives(rows, 10)


def test_cells_are_left_out_once_certified():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 1000
    x = np.floor(centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16)) * 20)
    labels = rng.integers(0, 2, 6000)
    shard = Shard(np.arange(6000), labels, x, (codebook(x[:1000, :8]), codebook(x[:1000, 8:])))
    read = []
    visit = shard.visit
    shard.visit = lambda q: ((b, read.append(len(r)) or r, s) for b, r, s in visit(q))
    scores = (x @ x[0]).astype(int)
    order = np.lexsort((np.arange(6000), -scores))
    same = [i for i in order if labels[i] == labels[0] and i != 0][:5]
    assert [i for _, i in positives_in(shard, 0, labels[0], x[0], 5)] == same
    assert sum(read) < 3000
    read.clear()
    p = int(scores[same[0]])
    want = [i for i in order if labels[i] != labels[0] and 50 * p <= 100 * scores[i] <= 95 * p][:3]
    assert [i for _, i in negatives_in(shard, labels[0], x[0], [p], 3)[0]] == want
    assert sum(read) <= 6000


def test_graph_finds_the_nearest_and_audits_widen():
    rng = np.random.default_rng(4)
    x = W.unit(rng.normal(size=(3000, 32)))
    x[1500:] = W.unit(x[:1500] + rng.normal(size=(1500, 32)) * 0.03)
    x = x.astype(np.float32)
    level = np.sort(W.levels(np.arange(3000)))[::-1]
    layers = W.build(x, level)
    want = set(zip(*map(np.ndarray.tolist, W.scan(x, x, 0.9)), strict=True))
    a, b = W.links_of(x, layers, x, 0.9, 16)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found <= want and len(found) > 0.95 * len(want)
    a, b = W.audited_links(x, layers, x, 0.9, 2)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True)) & want) > 0.99 * len(want)
