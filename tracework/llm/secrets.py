"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

DataFrame and SQL expressions only.  First-order models, one of each labelled kind of secrets and
one of ordinary identifiers, are trained on labelled samples; a token of mixed letters and digits is
a secret if the mean log-likelihood ratio of its character pairs says so for any kind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group that must reach a length, that length.
BASE = (
    (
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"(AKIA[A-Z0-9]{14,})", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
)
#: Tokens that the models judge, and the characters they know.
TOKEN = r"([A-Za-z0-9+/_=-]{20,})"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class Training:
    #: Documents with, and without, labelled secrets that a model is trained on, about, and at most twice as many.
    documents: int = 1000
    #: Pseudo-count of every pair of characters.
    smoothing: float = 0.5
    #: Share of a secrets' model that is even over the alphabet: random strings of letters that the samples lack.
    even: float = 0.3
    #: Mean log-likelihood ratio from which a token is a secret.
    ratio: float = 0.6


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """``array<struct<start,rank,kind,stop,value>>`` of the matches, leftmost and non-overlapping."""
    p = F.lit(pattern)
    hits, gaps = F.regexp_extract_all("text", p, F.lit(0)), F.split("text", pattern, -1)
    lengths = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda z: F.struct(F.length(z["g"]).alias("g"), F.coalesce(F.length(z["h"]), F.lit(0)).alias("h")))
    ends = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts")),
        lambda s, z: F.struct((s["at"] + z["g"] + z["h"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + z["g"])).alias("starts")),
    )["starts"]
    parts = F.regexp_extract_all("text", p, F.lit(group))
    rows = F.transform(
        F.arrays_zip(hits.alias("hit"), F.slice(ends, 1, F.size(hits)).alias("start"), parts.alias("part")),
        lambda z: F.struct(
            z["start"].cast("int").alias("start"),
            F.lit(order).alias("rank"),
            F.lit(kind).alias("kind"),
            (z["start"] + F.length(z["hit"])).cast("int").alias("stop"),
            z["part"].alias("value"),
        ),
    )
    rows = F.filter(rows, lambda r: F.length(r["value"]) >= least)
    return F.when(F.col("text").rlike(pattern), rows).otherwise(F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), F.lit(0).alias("stop"), F.lit("").alias("value"))), lambda r: F.lit(False)))


def _base(docs: DataFrame) -> DataFrame:
    spans = [_spans(kind, i, pattern, group, least).alias(kind) for i, (kind, pattern, group, least) in enumerate(BASE)]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *spans)


def labelled_sample(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """``kind, token``: values of the fixed patterns by their kind, and ordinary identifiers (kind null) of
    other documents.

    About ``training.documents`` documents of each sort take part: one count gives the share, and those
    whose hash falls below it are read again where they are, so no text is sorted or shuffled.
    """
    marked = F.col("text").rlike("|".join(f"(?:{p})" for _, p, _, _ in BASE))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.agg(F.count_if(marked).alias("marked"), F.count_if(~marked).alias("plain")).first()
    least = {k: min(1.0, training.documents / max(1, n[k])) for k in ("marked", "plain")}
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where(place <= max(least.values()))
    some = lambda sort, holds: rows.where(holds & (place <= least[sort])).limit(2 * training.documents)
    found = _base(some("marked", marked)).select(F.explode(F.concat(*[k for k, *_ in BASE])).alias("s"))
    plain = some("plain", ~marked).select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z0-9_-]{5,})"), F.lit(1))).alias("token"))
    secrets = found.select(F.col("s.kind").alias("kind"), F.col("s.value").alias("token"))
    return secrets.unionByName(plain.select(F.lit(None).cast("string").alias("kind"), "token"))


def train(sample: DataFrame, training: Training = Training()) -> dict[str, list[float]]:
    """Per kind of secrets the log-likelihood ratios of all pairs of the alphabet, row by row."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair")
    counts = sample.where(F.length("token") >= 2).select("kind", pair).groupBy("kind", "pair").count()
    n = {(r.kind, r.pair): r["count"] for r in counts.where(F.col("pair").rlike(f"^[{ALPHABET}]{{2}}$")).collect()}
    before: dict = {}
    for (kind, p), c in n.items():
        before[kind, p[0]] = before.get((kind, p[0]), 0) + c
    k, v = training.smoothing, len(ALPHABET)
    share = lambda kind, p: math.log((n.get((kind, p), 0) + k) / (before.get((kind, p[0]), 0) + k * v))
    secret = lambda kind, p: math.log((1 - training.even) * math.exp(share(kind, p)) + training.even / v)
    kinds = sorted({kind for kind, _ in n} - {None})
    return {kind: [round(secret(kind, a + b) - share(None, a + b), 4) for a in ALPHABET for b in ALPHABET] for kind in kinds}


def secret_scan(docs: DataFrame, ratios: dict[str, list[float]], training: Training = Training()) -> DataFrame:
    """``doc_id, text, assign, access, hex, markov``: spans (start, stop in code points, stop exclusive).

    One row per input row, repeated rows included; null texts count as empty, empty texts have no
    spans, an empty table gives no rows; texts of any length are scanned whole; other columns are left
    out, so clashing names do no harm.  A Markov span never overlaps a span of the fixed patterns, which
    stay as they are; without labelled secrets (no ``ratios``) there are none.
    """
    a = _base(docs).withColumn("token", _spans("markov", len(BASE), TOKEN, 1, 20))
    known = F.concat(*[k for k, *_ in BASE])
    apart = F.filter(
        F.filter("token", lambda t: t["value"].rlike("[0-9]") & t["value"].rlike("[A-Za-z]")),
        lambda t: ~F.exists(known, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
    )
    a = a.withColumn("token", apart)
    place = f"(instr('{ALPHABET}', substring(s.value, i, 1)) - 1) * {len(ALPHABET)} + instr('{ALPHABET}', substring(s.value, i + 1, 1)) - 1"
    means = []
    for i, (_, row) in enumerate(sorted(ratios.items())):
        table = F.split(F.lit(",".join(map(str, row))), ",").cast("array<double>")
        a = a.withColumn(f"ratios{i}", F.when(F.size("token") > 0, table))
        pairs = f"transform(sequence(1, length(s.value) - 1), i -> coalesce(get(ratios{i}, {place}), 0D))"
        means.append(f"aggregate({pairs}, 0D, (a, x) -> a + x) / (length(s.value) - 1)")
    is_secret = " or ".join(f"{mean} >= {training.ratio}D" for mean in means) or "false"
    a = a.withColumn("markov", F.expr(f"filter(token, s -> {is_secret})"))
    return a.select("doc_id", "text", *[k for k, *_ in BASE], "markov")


def summarise(scan: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the fixed patterns' spans, and all spans as text."""
    kinds = [k for k, *_ in BASE]
    listed = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return scan.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in kinds],
        F.sha2(listed(F.concat(*kinds)), 256).alias("base_sha256"),
        listed(F.concat(*kinds, "markov")).alias("spans"),
    )


def redacted(scan: DataFrame, mark: str = "[secret]") -> Column:
    """The text of a scan with every secret's value replaced by ``mark``."""
    values = F.array_distinct(F.transform(F.concat(*[k for k, *_ in BASE], "markov"), lambda s: s["value"]))
    return F.aggregate(F.reverse(F.array_sort(values, lambda x, y: F.length(x) - F.length(y))), F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark)))
