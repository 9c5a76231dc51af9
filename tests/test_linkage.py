"""Single-linkage clusters against all pairs on the driver, and bags without tokens."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tracework import catalogue
from tracework.operators import linkage as L

SF = "/root/testdata/sf0.001"


def by_all_pairs(bags, k, floor, least=2):
    """id -> cluster: Kruskal over all pairs."""
    df = Counter(w for b in bags.values() for w in set(b or []) if w is not None)
    vec = {}
    for i, b in bags.items():
        w = {t: n * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, n in Counter(x for x in b or [] if x is not None).items() if df[t] >= least}
        length = math.sqrt(sum(v * v for v in w.values()))
        if w:
            vec[i] = {t: math.floor(v / length * L.UNIT + 0.5) for t, v in w.items()}
    ids, first = sorted(vec), {}
    for i in ids:
        first.setdefault(tuple(sorted(vec[i].items())), i)
    nodes = sorted(first.values())
    edges = []
    for x, i in enumerate(nodes):
        for j in nodes[x + 1 :]:
            sim = sum(v * vec[j].get(t, 0) for t, v in vec[i].items())
            if sim >= int(floor * L.UNIT * L.UNIT):
                edges.append((-sim, i, j))
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    left = len(nodes)
    for _, i, j in sorted(edges):
        a, b = find(i), find(j)
        if a != b and left > k:
            root[max(a, b)] = min(a, b)
            left -= 1
    return {i: find(first[tuple(sorted(vec[i].items()))]) if i in vec else None for i in bags}


def clusters(spark, bags, k, floor):
    d = spark.createDataFrame([(i, b) for i, b in bags.items()], "id string, tokens array<string>")
    return {r["id"]: r["cluster"] for r in L.linked_clusters(d, "id", "tokens", k, floor).collect()}


def test_clusters_equal_all_pairs(spark):
    rng = random.Random(3)
    topics = [[f"t{n}_{i}" for i in range(12)] for n in range(6)]
    bags = {f"u{i:03}": rng.choices(rng.choice(topics), k=rng.randint(1, 9)) + rng.choices(["common", "often", f"x{i}"], k=2) for i in range(200)}
    for k, floor in ((6, 0.05), (40, 0.5)):
        want = by_all_pairs(bags, k, floor)
        assert clusters(spark, bags, k, floor) == want
        assert len(set(want.values()) - {None}) >= k


def test_blocks_give_the_same_clusters(spark, monkeypatch):
    rng = random.Random(4)
    bags = {f"u{i:03}": ["hot"] + rng.choices([f"w{n}" for n in range(15)], k=4) for i in range(60)}
    monkeypatch.setattr(L, "BLOCK", 8)
    assert clusters(spark, bags, 5, 0.1) == by_all_pairs(bags, 5, 0.1)


def test_odd_bags(spark):
    bags = {"a": ["x", "y"], "b": ["y", "x"], "c": None, "d": [], "e": [None, "x"], "f": ["once"], "g": ["z"] * 5000, "h": ["z"]}
    assert clusters(spark, bags, 2, 0.1) == by_all_pairs(bags, 2, 0.1)
    assert clusters(spark, bags, 100, 0.1) == by_all_pairs(bags, 100, 0.1)
    d = spark.createDataFrame([], "id string, tokens array<string>")
    assert L.linked_clusters(d, "id", "tokens", 3).columns == ["id", "tokens", "cluster"] and L.linked_clusters(d, "id", "tokens", 3).count() == 0


def test_units_in_linked_clusters(spark):
    rows = catalogue.queries()["unit_linkage"](spark, SF).collect()
    units = catalogue.queries()["bracket_pairs"](spark, SF).count()
    assert len(rows) == units and len({r["cluster"] for r in rows}) > 1


def test_a_core_needs_no_forest(spark, monkeypatch):
    """Bags that lie together above the cut are one node: only the few outside meet in groups."""
    rng = random.Random(5)
    bags = {f"u{i:03}": rng.choices([f"w{n}" for n in range(30)], k=min(2 + int(rng.expovariate(0.4)), 14)) for i in range(300)}
    links, met = L.links, []
    monkeypatch.setattr(L, "links", lambda nodes, floor: met.append(nodes.count()) or links(nodes, floor))
    for k, settings in ((4, {}), (9, {"WORDS": 200, "COLUMNS": 3, "ROWS": 7})):
        for name, value in settings.items():
            monkeypatch.setattr(L, name, value)
        want = by_all_pairs(bags, k, 0.2)
        assert clusters(spark, bags, k, 0.2) == want
        assert met.pop() < len(bags) / 2 and len(set(want.values())) == k


def test_without_a_core_all_bags_meet(spark, monkeypatch):
    rng = random.Random(6)
    bags = {f"u{i:03}": rng.choices([f"w{n}" for n in range(30)], k=rng.randint(2, 9)) for i in range(80)}
    monkeypatch.setattr(L, "PARTS", 0)
    assert clusters(spark, bags, 5, 0.2) == by_all_pairs(bags, 5, 0.2)
    assert clusters(spark, bags, 200, 0.2) == by_all_pairs(bags, 200, 0.2)
