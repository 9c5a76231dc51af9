"""Collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np

from tracework.llm.phrases import cohesion, collocations, frequent

SCHEMA = "doc_id bigint, text string, lang string"


def plain(rows, depth=3, least=10, most=2000, share=50):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = []
    for lang in n:
        c = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        kept = []
        for p, a in c.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in c.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def words(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "New", "york", "city", "Ünder", "\x01x", "co\x85op", "é", "#1", "of"]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!", "\r\n"]) for _ in range(n))


def test_collocations(spark):
    rows = [(i, words(i, 60), ["en", "de", None][i % 3]) for i in range(60)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, " .,! ", None), (103, "x y " * 20_000, "en"), (104, "one", "it"), (104, "one", "it")]
    d = spark.createDataFrame([(*r, "z", 3) for r in rows], SCHEMA + ", w string, route int")
    got = lambda **a: sorted(map(tuple, collocations(d, **a).collect()))
    assert got() == plain(rows)
    assert got(chunk=1000, most=7) == plain(rows, most=7)
    assert got(depth=4, least=3) == plain(rows, depth=4, least=3)


def test_collocations_of_nothing(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, "en")], SCHEMA)).collect() == []


def test_scores_are_exact(spark):
    rows = [(10**14 + 7, 10**14 + 9, 10**15 - 1), (3, 3, 3), (10**10, 10**11, 10**12 + 1)]
    d = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select("a", "l", "r", cohesion("a", "l", "r").alias("s"))
    assert [r.s for r in d.collect()] == [10**6 * a * a // (left * r) for a, left, r in rows]


def test_quicksort_counts_equal_partitions():
    rng = np.random.default_rng(5)
    for size, most in ((1, 1), (500, 3), (5000, 40)):
        keys, weights = np.sort(rng.integers(0, most + 1, (size, 3)), axis=1)[:, ::-1].copy(), rng.integers(1, 4, size)
        counts = Counter()
        for k, w in zip(map(tuple, keys.tolist()), weights.tolist(), strict=True):
            counts[k] += w
        rows, sums = frequent(keys, weights, 10)
        assert dict(zip(map(tuple, keys[rows].tolist()), sums.tolist(), strict=True)) == {k: n for k, n in counts.items() if n >= 10}
    assert len(frequent(np.zeros((0, 3), np.int64), np.zeros(0, np.int64), 1)[0]) == 0
