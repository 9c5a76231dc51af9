"""The queries' contracts against plain Python, and empty tables, nulls, repeats and clashing names."""

import collections
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_operators import LONG, ODD, SF
from tracework.llm import html, queries as Q, secrets, signatures, tokens, urls
from tracework.llm.decontaminate import benchmark_spans, summarise
from tracework.llm.neardup import near_duplicates
from tracework.llm.packing import pack_documents
from tracework.llm.quality import quality
from tracework.llm.tokenfile import read_token_file, write_token_file

SPACE = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_op2_lays_every_id_once(spark, docs):
    encode = library(Q.BYTE_FILE)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in Q.op2_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    total = 0
    for d, text in docs.items():
        ids, at = encode(text), 0
        total += len(ids)
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert total / (2048 * len(sequences)) > 0.95


def test_op7_equals_the_library(spark, docs):
    encode, at = library(Q.WORD_FILE), 0
    got = {r.doc_id: r for r in Q.op7_token_file(spark, SF).collect()}
    for d in sorted(docs):
        ids = encode(docs[d])
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("kind,path", [("byte", Q.BYTE_FILE), ("word", Q.WORD_FILE)])
def test_encoders_over_all_letters_and_white_space(kind, path):
    encode = library(path)
    white = [" ", "\n", "\t", "\r\n", *map(chr, (0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x1C))]
    texts = ["".join(map(chr, range(0x250))), *[f"a{chr(c)} {chr(c)}B {chr(c)} . x{chr(c)}{chr(c)} 's y" for c in range(0x250)]]
    texts += [f"x{a}{b}{c}y, z" for a in white for b in white for c in white] + ["".join(tokens._MARKS), f"{tokens._MARKS[0]} x  y", "é ́x H̱ ΣαΣ İ"]
    got = [x for batch in tokens.encoder(path, kind).batches(tokens.pa.array(texts)) for x in batch]
    assert [t for t, g in zip(texts, got, strict=True) if np.frombuffer(g, "<u4").tolist() != encode(t).tolist()[:-1]] == []


def test_op3_base_spans(spark, docs):
    rows = [(d, t) for d, t, _ in ODD if d is not None] + [(10_000 + d, t) for d, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.defaultdict(set)
    for r in secrets.summarise(secrets.secret_scan(df, {})).collect():
        got[r.doc_id].add((r.n_assign, r.n_access, r.n_hex, r.spans))
    for d, t in rows:
        spans = [(m.start(), i, kind, m.end()) for i, (kind, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if ok(m)]
        n = collections.Counter(s[2] for s in spans)
        assert (n["assign"], n["access"], n["hex"], ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))) in got[d]


def test_op3_models_find_random_keys(spark):
    rng = random.Random(5)
    token = lambda letters, n=32: "".join(rng.choice(letters) for _ in range(n))
    words = "river table window garden market simple number yellow system person".split()
    train = [(i, f"secret = {token('0123456789abcdef')} and AKIA{token(string.ascii_uppercase + string.digits, 16)}") for i in range(300)]
    form = lambda w: rng.choice((w, w.title(), w.upper()))
    train += [(1000 + i, " ".join(f"{form(rng.choice(words))}_{form(rng.choice(words))}{rng.randrange(9)}" for _ in range(30))) for i in range(300)]
    ratios = secrets.train(secrets.labelled_sample(spark.createDataFrame(train, "doc_id bigint, text string")))
    kinds = {"mixed": string.ascii_letters + string.digits, "upper": string.ascii_uppercase + string.digits, "lower": string.ascii_lowercase + string.digits}
    rows = [(k, f"see {token(v)} there") for k, v in kinds.items() for _ in range(100)]
    rows += [("ordinary", f"see {'_'.join(rng.choice(words) for _ in range(4))}{rng.randrange(9)} there") for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r.doc_id: r.share for r in secrets.secret_scan(df, ratios).groupBy("doc_id").agg(F.avg((F.size("markov") > 0).cast("int")).alias("share")).collect()}
    assert min(found[k] for k in kinds) >= 0.9 and found["ordinary"] <= 0.02


def test_op4_equals_all_rules_without_the_gate(spark, docs):
    rules = [(p, label, re.compile(x)) for p, label, _, x, _ in signatures.signature_rules()]
    texts = [t for _, t in sorted(docs.items())] + ["MIT license text, Apache License; general public license", "released under the bsd 3 clause. Permission is hereby granted, free of charge, to any person", None, ""]
    rows = signatures.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", texts[r.doc_id] or "")]
        joined = " " + "  ".join(words) + " "
        place = lambda i: joined[:i].count(" ") // 2
        found = [(p, label, place(m.start()), place(m.end())) for p, label, x in rules for m in x.finditer(joined)]
        inside = lambda e, d: e[2] <= d[2] and d[3] <= e[3] and (e[0] < d[0] or (e[3] - e[2] > d[3] - d[2] and e[0] <= d[0]))
        labels = {d[1] for d in found if not any(inside(e, d) for e in found)}
        base = [(label, i) for phrase, label in signatures.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert r.labels == ",".join(sorted(labels | {x for x, _ in base}))
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(base), ",".join(sorted({x for x, _ in base})))
        assert (r.first_word, r.last_word) == (min((i for _, i in base), default=None), max((i for _, i in base), default=None))


def test_op5_hosts_paths_and_rules(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").join(Q.op5_url_filter(spark, SF), "page_id").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(x), x, v) for v, x in urls.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        best = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[1]) and (best[2] is None or r.verdict == best[2])


def test_op5_words_label_pages_without_a_rule(spark):
    rows = [(i, f"http://casino-win.example.com/en/{i}") for i in range(20)] + [(100 + i, f"http://garden.example.com/a/b/c/d/e/{i}") for i in range(20)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.url_filter(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert all(got[i] == (None, "block") and got[100 + i] == (None, "allow") for i in range(20))


def test_op1_symbols(spark, docs):
    df = spark.createDataFrame([(d, t) for d, t, _ in ODD if d is not None], "doc_id bigint, text string")
    for r in quality(df).select("text", "quality.n_symbols").collect():
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))


def test_op6_sets_and_links_from_words(spark, docs):
    rows = [(d, t) for d, t in sorted(docs.items())[:100]] + [(5000 + d, (t or "").upper() + " tail words") for d, t in sorted(docs.items())[:30]] + [(9001, "Two Words"), (9002, "two words"), (9003, None), (9004, " \n")]

    def shingles(text):
        w = re.findall(SPACE, (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        return d if parent[d] == d else root(parent[d])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: (len(s), root(d), d == root(d)) for d, s in sets.items()}


def test_op10_pages_of_odd_form(spark):
    pages = [
        "<html><head><title>t</title><meta a=b><body><p>one</p><p>two</p>", "<html><head><title>t</title><p>no body tag</p>",
        "<article><div class='article-header'><h1>T</h1></div><p class=search>found</p><div class=ads>x</div><form>f</form></article>", None, "", "<p>&amp;&#65;  x\n y</p>", f"<article><p>{LONG}</p></article>",
    ]
    rows = [(i, f"http://h{i}.org/", h, "x", 1) for i, h in enumerate(pages)] + [(0, None, pages[0], "y", 2), (0, None, pages[0], "y", 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n bigint")
    got = collections.defaultdict(list)
    for r in html.extract(df).collect():
        got[r.page_id].append(r.text)
    assert got[0] == ["one\ntwo"] * 3 and [got[i] for i in range(1, 7)] == [["no body tag"], ["T\nfound"], [""], [""], ["&A x y"], [LONG]]
    assert html.extract(df.limit(0)).count() == 0


def test_empty_tables(spark, empty, tmp_path):
    assert quality(empty).count() == signatures.license_scan(empty).count() == near_duplicates(empty).count() == pack_documents(empty, Q.BYTE_FILE).count() == 0
    assert summarise(benchmark_spans(empty, spark.createDataFrame([], "item_id bigint, text string"))).count() == 0
    assert urls.url_filter(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    write_token_file(empty, str(tmp_path / "t"), Q.WORD_FILE)
    assert read_token_file(spark, str(tmp_path / "t")).count() == 0
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


NAMES = "doc_id bigint, text string, lang string, n_chars bigint, words string, kept boolean, spans string, quality string, component_id bigint, row string"


def test_pipeline_stages_keep_columns_and_rows(spark, docs):
    good = [t for t in docs.values() if t and len(t.split()) > 60][:8]
    rows = [(i, t, "en", len(t), "w", True, "s", "q", i, "r") for i, t in enumerate(good)]
    rows += [(0, good[0], "en", 1, "w", True, "s", "q", 0, "r")] * 2 + [(1, "another text " + LONG, "de", 2, "w", False, "s", "q", 1, "r")]
    rows += [(70, None, None, None, None, None, None, None, None, None), (71, "", "en", 0, "", None, "", "", 1, ""), (None, "x y z " + LONG, "en", 3, "w", True, "s", "q", 2, "r"), (72, "key secret = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "en", 4, "w", True, "s", "q", 3, "r")]
    df = spark.createDataFrame(rows, NAMES)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        if name == "near_dedup":
            kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
            ids = {d for d, _ in kept}
            assert set(kept.values()) == {1} and {70, 71, None} <= ids and (1 not in ids or (1, "another text " + LONG) in kept)
        if name == "secret_scan":
            texts = {r.doc_id: r.text for r in out.collect()}
            assert texts[72] == "key [secret]" or "24be64439e3e" not in texts[72]
        if name == "decontaminate":
            spans = {(r.doc_id, r.contaminated) for r in summarise(benchmark_spans(df, spark.read.parquet(f"{SF}/benchmark.parquet"))).collect()}
            assert {r.doc_id for r in out.collect()} == {d for d, bad in spans if not bad}
        if name == "quality_rules":
            verdicts = {r.doc_id: r.kept for r in quality(df.select("doc_id", "text")).select("doc_id", "quality.kept").collect()}
            assert {r.doc_id for r in out.collect()} <= {d for d, k in verdicts.items() if k} | {1, 0}
    pieces = P.packing(spark, df, SF).collect()
    assert sum(p.length for p in pieces) == sum(len(library(Q.BYTE_FILE)(r[1])) for r in rows)


def test_a_cluster_needs_a_shared_folder():
    from tracework.llm.common import use_checkpoints

    class Cluster:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Cluster()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        use_checkpoints(Session())
