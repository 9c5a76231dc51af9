"""Approval thresholds in Japanese regulation prose, and the tables of captured worklist screens.

Column expressions only.  Null text gives null; text without a match gives an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms in which regulations and screens are written.
TABULATED = r"(?U)(\d[\d,]*)\s*(万円|円)\s*(未満|以上|以下|超)\s*[：:]\s*([^\n。、]{2,20})"
WRITTEN_OUT = r"(?U)(\d[\d,]*)\s*(万円|円)\s*を?\s*(超える|超え|以上|未満|以下)\s*場合[はに]?[、]?\s*([^\r\n。]{2,30})"
APPROVER = r"(取締役会|部門長|役員|社長|上長)"
BODY = r"(?Us)[^\s。、：:]{1,20}規程\s*第[１1]条.*?(?:附則[^。]*。|$)"
CLOSING = r"(?s)^(.*?附則[^。]*。)"
TABLE_HEAD = r"(?:処理待ち一覧|申請一覧|一覧)\n((?:[^\n]+\n){3,10}?)(?=P\d+-\d+-\d+\n)"
ROW_ID = r"^P\d+-\d+-\d+$"
TITLE = r"(?U)([^\s。、：:]{2,24}(?:規程|手続き|手続|チェックリスト|一覧))\s*(?=第[１1]条|１[．.]|1[．.]|\r)"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _matches(text: Column, pattern: str) -> Column:
    """Array of structs g1..g4 of the matches."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3, 4)]
    return F.arrays_zip(*groups)


def _yen(m: Column) -> Column:
    n = F.replace(m["g1"], F.lit(","), F.lit("")).try_cast("bigint")
    return F.when(m["g2"] == "万円", n * 10_000).otherwise(n)


def threshold_rules(text: Column) -> Column:
    """``array<struct<yen, cmp, outcome>>`` ascending by yen (order of appearance on a tie), each rule once.

    Tabulated rules come before written-out ones; a written-out rule without an approver is a rate, no rule.
    """
    tab = F.transform(_matches(text, TABULATED), lambda m: F.struct(_yen(m).alias("yen"), m["g3"].alias("cmp"), _trim(m["g4"]).alias("outcome")))
    named = F.filter(_matches(text, WRITTEN_OUT), lambda m: m["g4"].rlike(APPROVER))
    out = F.transform(
        named,
        lambda m: F.struct(
            _yen(m).alias("yen"),
            F.when(m["g3"].startswith("超"), "超").otherwise(m["g3"]).alias("cmp"),
            F.concat(F.regexp_extract(m["g4"], APPROVER, 1), F.when(m["g4"].contains("決議"), "決議").otherwise("承認")).alias("outcome"),
        ),
    )
    once = F.array_distinct(F.concat(tab, out))
    placed = F.transform(once, lambda r, i: F.struct(r["yen"].alias("yen"), i.alias("i"), r.alias("rule")))
    return F.transform(F.array_sort(placed), lambda p: p["rule"])


def route_by(amount: Column, rules: Column) -> Column:
    """The outcome of an amount under the rules of its own row: a lower bound that holds overwrites, an
    upper bound that holds only fills; null if none holds."""

    def step(hit: Column, r: Column) -> Column:
        lower = ((r["cmp"] == "以上") & (amount >= r["yen"])) | ((r["cmp"] == "超") & (amount > r["yen"]))
        upper = ((r["cmp"] == "未満") & (amount < r["yen"])) | ((r["cmp"] == "以下") & (amount <= r["yen"]))
        return F.when(lower | (upper & hit.isNull()), r["outcome"]).otherwise(hit)

    return F.aggregate(rules, F.lit(None).cast("string"), step)


def governs(text: Column, subject: Column) -> Column:
    """Whether the first regulation body in the text names the subject; false for null or blank subjects."""
    body, what = F.regexp_substr(text, F.lit(BODY)), _trim(subject)
    return F.coalesce((what != "") & body.contains(what), F.lit(False))


def sanitised(body: Column, markers: list[str]) -> Column:
    """The body up to its closing provision, without the lines (split at carriage returns) that hold a marker."""
    cut = F.coalesce(F.nullif(F.regexp_extract(body, CLOSING, 1), F.lit("")), body)
    marked = lambda line: F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: line.contains(m))
    return _trim(F.array_join(F.filter(F.split(cut, "\r"), lambda line: ~marked(line)), "\r"))


def screen_rows(text: Column) -> Column:
    """``array<map<column, cell>>`` of a captured worklist: the printed header gives the columns, a row begins at
    a row id and takes as many lines; other lines are passed over.  Empty without a header of 3 to 10
    columns, all different (a map holds each once), that begins with ID."""
    head = F.regexp_substr(text, F.lit(TABLE_HEAD))
    cols = F.filter(F.transform(F.split(F.regexp_extract(text, TABLE_HEAD, 1), "\n"), _trim), lambda c: c != "")
    width = F.size(cols)
    good = (width >= 3) & (width <= 10) & (F.get(cols, F.lit(0)) == "ID") & (F.size(F.array_distinct(cols)) == width)
    lines = F.transform(F.split(F.substr(text, F.instr(text, head) + F.length(head)), "\n"), _trim)
    last = F.size(lines) - width
    starts = F.aggregate(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("at")),
        lambda s, i: F.when((i >= s["free"]) & F.get(lines, i).rlike(ROW_ID), F.struct((i + width).alias("free"), F.array_append(s["at"], i).alias("at"))).otherwise(s),
    )["at"]
    rows = F.transform(starts, lambda i: F.map_from_arrays(cols, F.slice(lines, i + 1, width)))
    return F.when(good, rows).otherwise(F.array().cast("array<map<string,string>>"))


def drafted_rules(reply: Column) -> Column:
    """Rules of a JSON reply, fenced or not, in the order of (yen, cmp, outcome); null if it is no rule list."""
    body = _trim(F.regexp_replace(_trim(reply), r"^```[a-z]*|```$", ""))
    rules = F.from_json(body, "array<struct<yen: bigint, cmp: string, outcome: string>>")
    return F.when(body.startswith("["), F.array_sort(F.array_distinct(rules)))


def same_rules(a: Column, b: Column) -> Column:
    """Whether two rule arrays hold the same rules, in any order; null if either is null."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def ungoverned(mode: Column, text: Column, subject: Column) -> Column:
    """Whether a row was routed by a threshold rule although the regulation does not name its subject."""
    return (mode == "automated_by_rule") & ~governs(text, subject)


def bodies(text: Column) -> Column:
    """``map<title, body>`` of the regulations in a capture: each runs from its printed title to the next one; of equal
    titles the last counts.  Empty for null."""
    titles = F.regexp_extract_all(text, F.lit(TITLE), F.lit(1))
    parts = F.split(text, TITLE)  # the text before the first title, then what follows each title
    heads = F.regexp_extract_all(text, F.lit(TITLE), F.lit(0))
    each = F.transform(titles, lambda t, i: F.struct(t.alias("title"), F.concat(F.get(heads, i), F.get(parts, i + 1)).alias("body"), i.alias("i")))
    last = F.filter(each, lambda x: ~F.exists(each, lambda y: (y["title"] == x["title"]) & (y["i"] > x["i"])))
    return F.map_from_entries(F.coalesce(F.transform(last, lambda x: F.struct(x["title"], x["body"])), F.array().cast("array<struct<title:string,body:string>>")))


def corpus(texts: DataFrame, text: str) -> DataFrame:
    """``title, body``: of each regulation the longest captured body, the greater text on a tie."""
    each = texts.select(F.explode(bodies(F.col(text))).alias("title", "body"))
    return each.groupBy("title").agg(F.max(F.struct(F.length("body").alias("n"), "body")).alias("x")).select("title", "x.body")


def filled_template(template: Column, row: Column, fallback: Column) -> Column:
    """``template`` with each ``{column}`` replaced from the map ``row`` (null cells are empty); ``fallback`` if a column is unknown.

    One scan over the template's parts: what a cell holds isn't read as a template again.
    """
    parts = F.split(template, r"\{")
    name = lambda p: F.substring_index(p, "}", 1)
    closed = lambda p: F.contains(p, F.lit("}"))
    rest = lambda p: F.substr(p, F.length(name(p)) + 2)
    fill = lambda p: F.when(closed(p), F.concat(F.coalesce(F.element_at(row, name(p)), F.lit("")), rest(p))).otherwise(F.concat(F.lit("{"), p))
    later = F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts)))
    unknown = F.exists(later, lambda p: closed(p) & ~F.map_contains_key(row, name(p)))
    return F.when(unknown, fallback).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(later, fill), "")))
