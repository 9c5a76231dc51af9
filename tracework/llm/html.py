"""Main text of web pages by union-free wrappers, inferred per host.

A page is a stream of structure tokens (open and close tags with their class, text with its place).
Texts that most forms of a host hold at one place are candidates; the others become slots, repeated
groups are folded to one group each, and the distinct forms of a host are aligned one after the
other.  Where they differ, unequal texts become a slot and unmatched tokens an optional group.  What
is left is a regular expression without unions, the host's wrapper.  On every page, its constants
are furniture and its slots are main text, inside the main region if the page names one; where all
its slots stand in regions that class names mark as furniture, it overrides those marks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .urls import split_url

#: Elements whose content is no main text, elements of raw text, and void elements.
FURNITURE = frozenset("nav header footer aside form menu dialog button select option noscript template svg iframe head".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that mark an element as furniture.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|rail|header|masthead|footer|banner|ads?|advert\w*|sponsor\w*|promo\w*|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|"
    r"related|recommend\w*|comments?|replies|reply|respond|disqus|form|search|toolbar|pager|pagination|widget|skip)(?:$|[\s_-])"
)
#: Of these, words that inside a main region name its own parts as often as furniture.
WEAK = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead|search|form|login|toolbar|skip|menu|widget|rail)(?=$|[\s_-])")
#: Bytes of wrappers that are broadcast at once; each further block is one more pass over the pages.
BROADCAST_BYTES = 8_000_000
#: Elements that may stand in a head; any other one ends it.
IN_HEAD = frozenset("head title meta link base style script noscript template".split())
#: Forms that must hold a text at one place (and more than half of a group's) before it can be a constant.
CONSTANT = 3
#: Forms of one host that one task aligns; a host of more is aligned level by level.
GROUP = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def stream(html: str) -> Iterator[tuple[str, str, str]]:
    """("open" | "close" | "text", tag, marks or text) tokens; comments, scripts and styles are left out."""
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else size]
        if text:
            yield "text", "", text
        if not m:
            return
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            yield "close", tag, ""
            continue
        marks = " ".join(a or b or c for _, a, b, c in _NAMED.findall(m[3] or "")).lower()
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        yield "open", tag, marks
        if tag in VOID or (m[3] or "").endswith("/"):
            continue


def parse(html: str) -> tuple[list[tuple[str, bool, str, str]], list[str], bool]:
    """Blocks (path, kept in a main region, text, token), the structure tokens, and whether a main region is named.

    A text's token is ``#hash@place``.  A place is the kind of region and a hash of the path; kinds are m
    (main), p (plain), and y and x for the same under an element that its class marks as furniture.
    What lies inside elements that are furniture by their tag has no blocks and no tokens.
    """
    blocks: list[tuple[str, bool, str, str]] = []
    form: list[str] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # block elements, whether they are furniture, and whether by their tag
    dropped, hard, main, named = 0, 0, 0, False

    def flush() -> None:
        text = " ".join(unescape("".join(buffer)).split())
        buffer.clear()
        if text and not hard:
            path = "/".join(t for t, _, _ in stack)
            kind = ("y" if main else "x") if dropped else "m" if main else "p"
            form.append(f"#{xxhash.xxh3_64_hexdigest(text)}@{kind}{xxhash.xxh32_hexdigest(path)}")
            blocks.append((path, kind == "m", text, form[-1]))

    for kind, tag, value in stream(html):
        if kind == "text":
            if not hard:
                buffer.append(value)
        elif kind == "open":
            if tag not in IN_HEAD and any(t == "head" for t, _, _ in stack):
                while True:  # a head that was never closed
                    t, off, by_tag = stack.pop()
                    dropped, hard = dropped - off, hard - by_tag
                    if t == "head":
                        break
            if tag in BLOCKS or tag in FURNITURE:
                flush()
                if tag in ("article", "main") and dropped and not any(t in ("article", "main") for t, _, _ in stack):
                    stack, dropped, hard = [(t, False, False) for t, off, _ in stack if not off], 0, 0  # furniture that was never closed
                if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                    _, off, by_tag = stack.pop()
                    dropped, hard = dropped - off, hard - by_tag
                if tag in VOID:
                    continue
                bare = value if tag not in ("html", "body") else ""
                if main:
                    bare = WEAK.sub("", bare)
                off = tag in FURNITURE or bool(bare and MARKS.search(bare))
                if tag == "header" and main:  # the head of an article is part of it
                    off = bool(MARKS.search(bare))
                if tag in ("article", "main") and not main:
                    off = off and tag != "main" and bool(MARKS.search(bare))
                if not hard:
                    form.append(f"<{tag} {value}>" if value else f"<{tag}>")
                by_tag = off and tag in FURNITURE and not (tag == "header" and main)
                stack.append((tag, off, by_tag))
                dropped, hard = dropped + off, hard + by_tag
                if tag in ("article", "main") and not dropped:
                    main, named = main + 1, True
            elif tag == "br":
                buffer.append(" ")
        elif tag in BLOCKS or tag in FURNITURE:
            flush()
            if any(t == tag for t, _, _ in stack):
                while True:
                    t, off, by_tag = stack.pop()
                    if t in ("article", "main") and not dropped:
                        main -= 1
                    dropped, hard = dropped - off, hard - by_tag
                    if t == tag:
                        break
                if not hard:
                    form.append(f"</{tag}>")
    flush()
    return blocks, form, named


def _key(token: str) -> str:
    """What tokens must share to be equal: a slot or text its place, other tokens all but the mark "?"."""
    token = token.rstrip("?")
    return "#" + "".join(token.partition("@")[1:]) if token[0] == "#" else token


def fold(form: list[str], widest: int = 12) -> list[str]:
    """``form`` with each run of equal groups as one group: texts of repeated groups become slots."""
    shape = [_key(t) for t in form]
    for width in range(1, widest + 1):
        out, kept, i = [], [], 0
        while i < len(shape):
            if len(kept) >= width and shape[i : i + width] == kept[-width:] and len(shape) - i >= width:
                for k in range(width):
                    if out[-width + k] != form[i + k] and out[-width + k][0] == "#":
                        out[-width + k] = _key(form[i + k])
                i += width
            else:
                out.append(form[i])
                kept.append(shape[i])
                i += 1
        form, shape = out, kept
    return form


def _best(k: int, p: int, keys: np.ndarray, places: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of best scores, from the row below it, for a token of key ``k`` and place ``p``; and its fits."""
    fit = (keys == k).astype(np.int32) + (places == p)
    row = np.append(np.maximum(below[:-1], np.where(fit > 0, below[1:] + fit, 0)), 0).astype(np.int32)
    return np.maximum.accumulate(row[::-1])[::-1], fit


def _moves(x: list[str], y: list[str]) -> Iterator[int]:
    """The best alignment of keys ``x`` and ``y`` from its start: 0 takes both tokens, 1 that of ``x``, 2 that of ``y``.

    Equal keys score 2, a text and a slot (or another text) of one place 1.  Of every ``step`` rows of
    scores one is kept and the others are found again on the way, so memory grows with ``y`` times the root of ``x``.
    """
    n, m = len(x), len(y)
    if not n or not m:
        yield from [1] * n + [2] * m
        return
    names: dict = {}
    code = lambda tokens: np.array([names.setdefault(t, len(names)) for t in tokens], np.int32)
    place = lambda t: t.partition("@")[1:] if t[0] in "#=" else t
    kx, ky, px, py = code(x), code(y), code(map(place, x)), code(map(place, y))
    step = 2 * math.isqrt(n) + 1
    row, kept = np.zeros(m + 1, np.int32), {}
    for i in range(n, 0, -1):
        if i % step == 0 or i == n:
            kept[i] = row
        if i <= step:
            break
        row = _best(kx[i - 1], px[i - 1], ky, py, row)[0]
    i = j = 0
    while i < n and j < m:
        if i % step == 0:
            top = min(i + step, n)
            row, moves = kept.pop(top), np.empty((top - i, m), np.uint8)
            for r in range(top - 1, i - 1, -1):
                below = row
                row, fit = _best(kx[r], px[r], ky, py, below)
                moves[r - i] = np.where((fit > 0) & (row[:-1] == below[1:] + fit), 0, np.where(below[:-1] >= row[1:], 1, 2))
        at = i % step
        while at < len(moves) and j < m:
            move = int(moves[at, j])
            yield move
            at, i, j = at + (move < 2), i + (move < 2), j + (move != 1)
    yield from [1] * (n - i) + [2] * (m - j)


def align(wrapper: list[str], form: list[str]) -> list[str]:
    """The wrapper that fits both: texts that differ are slots, unmatched tokens optional ("?")."""
    a = [t.rstrip("?") for t in wrapper]
    x, y = [_key(t) for t in a], [_key(t) for t in form]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out = []

    def both(i: int, j: int) -> None:
        mark = "?" if wrapper[i].endswith("?") or form[j].endswith("?") else ""
        slot = "#" + "".join(a[i].partition("@")[1:]) if a[i][0] in "#=" else a[i]
        out.append((a[i] if a[i] == form[j].rstrip("?") else slot) + mark)

    for i in range(head):
        both(i, i)
    i = j = head
    for move in _moves(x[head : len(x) - tail], y[head : len(y) - tail]):
        if move == 0:
            both(i, j)
        else:
            out.append((a[i] if move == 1 else form[j].rstrip("?")) + "?")
        i, j = i + (move < 2), j + (move != 1)
    for t in range(tail, 0, -1):
        both(len(x) - t, len(y) - t)
    return out


def _former(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = ["\n".join(parse(html.as_py() or "")[1]) or None for html in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(forms, pa.string())], names=["host", "form"])


def infer(forms: list[list[str]], first: bool = True) -> list[str]:
    """One wrapper of ``forms``: ``=hash@place`` constants, ``#@place`` slots, tags, each optional with "?".

    At the ``first`` level texts that enough forms hold at one place enter the alignment as they are
    and the others as slots; a place where the alignment finds anything else is a slot after all.
    """
    if first:
        count: dict[str, int] = {}
        for form in forms:
            for t in {t for t in form if t[0] == "#"}:
                count[t] = count.get(t, 0) + 1
        stable = {t for t, c in count.items() if c >= CONSTANT and 2 * c > len(forms)}
        forms = [fold(["=" + t[1:] if t in stable else _key(t) for t in form]) for form in forms]
    wrapper, *others = dict.fromkeys(map(tuple, forms))
    wrapper = list(wrapper)
    for form in others:
        wrapper = align(wrapper, list(form))
    return wrapper


def _inferrer(first: bool):
    def wrap(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("form").to_pylist(), group.column("n").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
        text = "\n".join(infer([form.split("\n") for form, _ in rows], first))
        return pa.table({"host": [group.column("host")[0].as_py()], "form": [text], "n": [sum(r[1] for r in rows)]})

    return wrap


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, n, constants, slots``: the constants (hash@place) and places of slots of each host's wrapper.

    Equal forms count once.  At most ``GROUP`` forms, about, meet in one task; the wrappers of a
    host's groups are aligned again, level by level, until one is left.
    """
    forms = pages.select(F.coalesce(split_url(F.col("url"))[0], F.lit("")).alias("host"), F.col("html").cast("string").alias("html"))
    forms = forms.mapInArrow(_former, "host string, form string").where("form is not null").groupBy("host", "form").agg(F.count("*").alias("n"))
    forms, first = keep(forms, "forms"), True
    while True:
        counts = forms.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
        salted = forms.join(counts, "host").withColumn("salt", F.pmod(F.xxhash64("form"), F.col("groups")))
        salted = salted.repartition("host", "salt")  # else the join's dealing by host would serve
        forms = keep(salted.groupBy("host", "salt").applyInArrow(_inferrer(first), "host string, form string, n bigint"), "wrappers")
        first = False
        if not forms.groupBy("host").count().where("count > 1").limit(1).count():
            break
    tokens = F.array_distinct(F.transform(F.split("form", "\n"), lambda t: F.rtrim(t, F.lit("?"))))
    of = lambda sign, cut: F.transform(F.filter(tokens, lambda t: t.startswith(sign)), lambda t: F.substr(t, F.lit(cut)))
    # written once, so that the size of the rows that meet the pages is known
    return keep(forms.select("host", "n", of("=", 2).alias("constants"), of("#", 3).alias("slots")), "constants")


def main_blocks(html: str, n: int, constants: frozenset[str], slots: frozenset[str]) -> list[str]:
    """The texts of ``html`` that its host's wrapper, of ``n`` pages, leaves as main text; ``slots`` are the kinds of region
    that its slots stand in.

    Constants that make up more than half of a named main region are kept: it is a page that the
    host holds in many copies.
    """
    blocks, _, named = parse(html)
    kinds = ("m", "y") if named else ("p", "x")
    place = lambda b: b[3].partition("@")[2]
    if n >= CONSTANT and kinds[1] in slots and kinds[0] not in slots:
        blocks = [b for b in blocks if place(b)[0] in kinds]
    else:
        blocks = [b for b in blocks if place(b)[0] == kinds[0]]
    free = [b for b in blocks if b[3][1:] not in constants]
    if named and 2 * sum(len(b[2]) for b in free) < sum(len(b[2]) for b in blocks):
        free = blocks
    return [b[2] for b in free]


def _extractor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, none = shared.value, (0, frozenset(), frozenset())
        for batch in batches:
            texts = []
            for html, host in zip(batch.column("html"), batch.column("host").to_pylist(), strict=True):
                texts.append("\n".join(main_blocks(html.as_py() or "", *known.get(host, none))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: one row per input row, blocks of main text joined by line feeds.

    Null and empty html give an empty text; pages with a null url or one without a host share the
    wrapper of the empty host.  Repeated rows stay; an empty table gives no rows; html of any length is
    read whole.  Other columns are left out, so clashing names do no harm.
    """
    host = F.coalesce(split_url(F.col("url"))[0], F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    # of the slots their kinds of region are enough here
    known = wrappers(pages).select("host", "n", "constants", F.array_distinct(F.transform("slots", lambda s: F.substring(s, 1, 1))).alias("kinds"))
    size = known.agg(F.sum(F.octet_length("host") + 100 + 24 * F.size("constants"))).first()[0] or 0
    blocks, out = max(1, -(-size // BROADCAST_BYTES)), None
    id_type = pages.schema["page_id"].dataType.simpleString()
    for k in range(blocks):
        own = F.pmod(F.xxhash64("host"), F.lit(blocks)) == k
        part = {r.host: (r.n, frozenset(r.constants), frozenset(r.kinds)) for r in known.where(own).toLocalIterator()}
        here = rows.where(own).mapInArrow(_extractor(pages.sparkSession.sparkContext.broadcast(part)), f"page_id {id_type}, url string, text string")
        out = here if out is None else out.unionByName(here)
    return out
