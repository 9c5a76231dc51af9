"""Hierarchical navigable small-world graphs in numpy: built and searched for many vectors in step.

Nodes are numbered by falling level, so the nodes of a layer are a prefix of all.  A layer is filled in batches:
each batch is searched in the graph of those before it, its own members are compared with each other, and of the
nearest found each node keeps a diverse few (a candidate stays if it is nearer to the node than to any kept one).
"""

from __future__ import annotations

import numpy as np

#: Links of a node in the upper layers; the lowest has twice as many.
DEGREE = 16
#: Vectors that are searched in step, and the nodes that each of them expands in a step.
BATCH, STEP = 256, 4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; no row is zero."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def levels(keys: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The level of each node, geometric in a hash of its key."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.floor(-np.log(u) / np.log(degree)).astype(np.int64)


def _similar(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.matmul(x[ids], q[:, :, None])[:, :, 0]


def search(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, least: float = 2.0, around=None):
    """Walks from ``start`` (an id per query) with a beam: ids and similarities [queries, beam], best first (-1: none),
    and the pairs (query, id) met whose similarity is ``least`` or more, whether or not the beam had room for them.
    With ``around`` (of ``both_ways``) each such pair is followed to its neighbours of that similarity, too."""
    n, size = len(q), len(links)
    rows = np.arange(n)
    ids = np.full((n, beam), -1, np.int64)
    sim = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, size), bool)
    ids[:, 0], done[:, 0] = start, False
    sim[:, 0] = _similar(x, q, start[:, None])[:, 0]
    seen[rows, start] = True
    first = sim[:, 0] >= least
    met = [(rows[first], start[first])]
    open_ = rows
    while len(open_):
        ahead = np.where(done[open_], -np.inf, sim[open_])
        best = np.argsort(-ahead, axis=1)[:, : min(STEP, beam)]
        live = np.take_along_axis(ahead, best, 1) > -np.inf
        going = live[:, 0]
        open_, best, live = open_[going], best[going], live[going]
        if not len(open_):
            break
        done[open_[:, None], best] |= live
        near = np.where(live[:, :, None], links[np.where(live, ids[open_[:, None], best], 0)], -1).reshape(len(open_), -1)
        near.sort(axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~seen[open_[:, None], np.maximum(near, 0)]
        near = np.where(new, near, 0)
        s = np.where(new, _similar(x, q[open_], near), -np.inf).astype(np.float32)
        r, c = np.nonzero(new)
        seen[open_[r], near[r, c]] = True
        r, c = np.nonzero(s >= least)
        met.append((open_[r], near[r, c]))
        all_sim = np.concatenate([sim[open_], s], 1)
        top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        take = lambda old, more: np.take_along_axis(np.concatenate([old, more], 1), top, 1)
        ids[open_], done[open_] = take(ids[open_], np.where(new, near, -1)), take(done[open_], ~new)
        sim[open_] = np.take_along_axis(all_sim, top, 1)
    if around:
        _flood(x, around, q, seen, met, least)
    order = np.argsort(-sim, axis=1, kind="stable")
    pairs = np.concatenate([a for a, _ in met]), np.concatenate([b for _, b in met])
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1), pairs


def both_ways(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of each node by links out of it or into it: where its list begins, and all lists."""
    src, k = np.nonzero(links >= 0)
    dst = links[src, k]
    edges = np.unique(np.concatenate([src * np.int64(len(links)) + dst, dst * np.int64(len(links)) + src]))
    starts = np.searchsorted(edges, np.arange(len(links) + 1) * np.int64(len(links)))
    return starts, edges % max(1, len(links))


def _flood(x, around, q, seen, met, least) -> None:
    """Goes on from every pair met to the neighbours that are as similar, until there are no more."""
    starts, lists = around
    front = [(np.concatenate([a for a, _ in met]), np.concatenate([b for _, b in met]))]
    while front:
        rows, nodes = front.pop()
        if len(rows) > 1024:
            front += [(rows[i : i + 1024], nodes[i : i + 1024]) for i in range(0, len(rows), 1024)]
            continue
        sizes = starts[nodes + 1] - starts[nodes]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[nodes], sizes)
        rows, near = np.repeat(rows, sizes), lists[at]
        new = ~seen[rows, near]
        pairs = np.unique(rows[new] * np.int64(len(x)) + near[new])
        a, b = pairs // len(x), pairs % len(x)
        seen[a, b] = True
        hit = np.einsum("ij,ij->i", x[b], q[a]) >= least
        if hit.any():
            met.append((a[hit], b[hit]))
            front.append((a[hit], b[hit]))


def _diverse(x: np.ndarray, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) a diverse ``most``, filled up with the nearest of the others."""
    v = x[np.maximum(ids, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        close = (kept[:, :k] & (between[:, k, :k] >= sim[:, k, None])).any(axis=1)
        kept[:, k] = (ids[:, k] >= 0) & ~close & (kept[:, :k].sum(axis=1) < most)
    rank = np.where(kept, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _nearest_first(ids: np.ndarray, sim: np.ndarray, most: int):
    """Rows sorted by similarity, each id once."""
    order = np.lexsort((ids, -sim), axis=1)
    ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
    ids[:, 1:][(ids[:, 1:] == ids[:, :-1])] = -1
    sim = np.where(ids >= 0, sim, -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, most: int) -> None:
    """Adds to the neighbours of the ``new`` nodes the way back, and prunes their lists."""
    src = np.repeat(new, links.shape[1])
    dst = links[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    s = np.einsum("ij,ij->i", x[src], x[dst])
    order = np.lexsort((-s, dst))
    src, dst, s = src[order], dst[order], s[order]
    nodes, at, counts = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(at, counts)
    fits = place < most
    extra = np.full((len(nodes), most), -1, np.int64)
    extra[np.repeat(np.arange(len(nodes)), counts)[fits], place[fits]] = src[fits]
    for i in range(0, len(nodes), 1024):
        own = nodes[i : i + 1024]
        ids = np.concatenate([links[own], extra[i : i + 1024]], 1)
        sim = np.where(ids >= 0, _similar(x, x[own], np.maximum(ids, 0)), -np.inf)
        ids, sim = _nearest_first(ids, sim, ids.shape[1])
        links[own] = _diverse(x, ids, sim, most)


def build(x: np.ndarray, level: np.ndarray, beam: int = 64, degree: int = DEGREE) -> list[np.ndarray]:
    """The links of each layer, from the lowest: ids [nodes of the layer, degree], -1 for none.

    ``level`` falls (nodes are numbered by it)."""
    layers: list[np.ndarray] = []
    tops = range(int(level[0]) if len(level) else 0, -1, -1)
    for lev in tops:
        n, most = int((level >= lev).sum()), degree * (1 if lev else 2)
        links = np.full((n, most), -1, np.int64)
        at = 0
        while at < n:
            size = min(n - at, max(128, min(at, 512)))
            new = np.arange(at, at + size)
            inner = x[new] @ x[new].T
            np.fill_diagonal(inner, -np.inf)
            few = min(size, most)
            near = np.argpartition(-inner, few - 1, axis=1)[:, :few]
            sim = np.take_along_axis(inner, near, 1)
            ids = np.where(sim > -np.inf, near + at, -1)
            if at:
                found = [search(x, links[:at], x[new[i : i + BATCH]], _entries(x, layers, x[new[i : i + BATCH]], at), beam)[:2] for i in range(0, size, BATCH)]
                ids = np.concatenate([ids, np.concatenate([a for a, _ in found])], 1)
                sim = np.concatenate([sim, np.concatenate([b for _, b in found])], 1)
            ids, sim = _nearest_first(ids, sim, beam)
            links[new] = _diverse(x, ids, sim, degree if lev else most)
            _link_back(x, links, new, most)
            at += size
        layers.insert(0, links)
    return layers


def _entries(x: np.ndarray, above: list[np.ndarray], q: np.ndarray, below: int) -> np.ndarray:
    """The node from which each query enters a layer: the nearest found in the layers ``above`` it (listed from the lowest)."""
    at = np.zeros(len(q), np.int64)
    for links in reversed(above):
        if len(links) <= below:
            at = search(x, links, q, at, 4)[0][:, 0]
    return at


def links_of(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) found with a similarity of ``least`` or more."""
    none = np.zeros(0, np.int64)
    a, b, around = [none], [none], both_ways(layers[0])
    for i in range(0, len(q), BATCH):
        part = q[i : i + BATCH]
        r, c = search(x, layers[0], part, _entries(x, layers[1:], part, len(x)), beam, least, around)[2]
        a.append(r + i)
        b.append(c)
    return np.concatenate(a), np.concatenate(b)


def scan(x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs by comparing all."""
    none = np.zeros(0, np.int64)
    a, b = [none], [none]
    for i in range(0, len(q), BATCH):
        r, c = np.nonzero(q[i : i + BATCH] @ x.T >= least)
        a.append(r + i)
        b.append(c)
    return np.concatenate(a), np.concatenate(b)


def audited_links(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, least: float, beam: int = 16, sample: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """``links_of`` with a beam that doubles until no link of an audited sample of the queries is missing.

    The sample is spread evenly over the queries and compared with every node; a beam of a quarter of all nodes gives
    way to comparing all.
    """
    own = np.unique(np.linspace(0, len(q) - 1, min(len(q), max(sample, len(q) // 8))).astype(np.int64))
    a, b = scan(x, q[own], least)
    truth = own[a] * np.int64(len(x)) + b
    while 4 * beam <= len(x):
        a, b = links_of(x, layers, q, least, beam)
        if np.isin(truth, a * np.int64(len(x)) + b).all():
            return a, b
        beam *= 2
    return scan(x, q, least)
