"""Labels of units from what the screen showed: systems, routes, documents, and the state in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CASE_ID, case_ids
from .intervals import BUCKET
from .scan import SLOT, running, slotted

# The forms of window titles, labelled rows, memos, logins and breadcrumbs.
MORE_PAGES = r"(?U)\s+and\s+\d+\s+more\s+pages?$"
LABELLED_ROW = r"(?U)^\s*(\D+?)\s+(" + CASE_ID.removeprefix("(?U)") + r")\s*$"
DOCUMENT = r"(?U)^(.*?)\s+(?:-|\[)\s*Compatibility Mode"
MEMO = "完了|承認済|確定|登録済"
LOGIN = r"([一-鿿]{2,4}\s+[一-鿿]{2,4})\s*·\s*([一-鿿ァ-ヿ]+マネージャー)"
BREADCRUMB = r"ダッシュボード / ([^\n]+)"


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_head(title: Column) -> Column:
    """The part of a window title before the first " - ", without a count of further pages."""
    return strip(F.regexp_replace(strip(F.get(F.split(title, " - "), F.lit(0))), MORE_PAGES, ""))


def document_title(title: Column) -> Column:
    """The name of the document that a title shows; null if it shows none."""
    return F.nullif(strip(F.regexp_extract(title, DOCUMENT, 1)), F.lit(""))


def slug(name: Column) -> Column:
    """A stable short token for a system without a name of its own."""
    return F.concat(F.lit("sys_"), F.substring(F.sha1(F.encode(name, "utf-8")), 1, 4))


def first_contained(text: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first entry (fragment, value) whose fragment the text contains; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table], F.lit(None).cast("string"))


def system_of(title: Column, tab: Column, systems: list[tuple[str, str]]) -> Column:
    return F.coalesce(first_contained(title, systems), first_contained(tab, systems))


def route_of_text(text: Column, table: list[tuple[str, str]]) -> Column:
    """The route of an on-screen text: of the entry that it equals, else of the first one that it contains."""
    s = strip(text)
    return F.coalesce(*[F.when(s == k, F.lit(v)) for k, v in table], first_contained(s, table))


def first_matches(texts: DataFrame, vocabulary: DataFrame, gram: int = 3) -> DataFrame:
    """``text, fragment``: for each distinct ``text`` the least ``fragment`` of the vocabulary that it contains.

    Texts and fragments meet by the part of ``gram`` characters that the fewest fragments share (shorter fragments by
    themselves), so neither is collected and a vocabulary of any size is a join.  Nulls are left out; the empty
    fragment is in every text.
    """
    def parts(c: Column, n: int) -> Column:
        places = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substr(c, i, F.lit(n)))

    f, t = F.col("fragment"), F.col("text")
    v = vocabulary.select("fragment").where(f.isNotNull()).distinct()
    own = v.withColumn("part", F.explode(F.when(F.length(f) < gram, F.array(f)).otherwise(F.array_distinct(parts(f, gram)))))
    shared = own.withColumn("n", F.count("*").over(Window.partitionBy("part")))
    rarest = shared.groupBy("fragment").agg(F.min(F.struct("n", "part")).alias("x")).select("fragment", F.col("x.part").alias("part"))
    every = F.array_distinct(F.concat(F.array(F.lit("")), *[parts(t, n) for n in range(1, gram + 1)]))
    d = texts.select("text").where(t.isNotNull()).distinct().withColumn("part", F.explode(every))
    return d.join(rarest, "part").where(F.contains(t, f)).groupBy("text").agg(F.min("fragment").alias("fragment"))


def first_place(path: Column) -> Column:
    return F.nullif(path, F.lit(""))


def filled(df: DataFrame, keys: list[str], order: list[Column], values: list[str], width: int = BUCKET, large: DataFrame | None | str = "count") -> DataFrame:
    """Each of ``values`` filled forward, then backward where nothing came before; empty strings count as nulls."""
    own = {v: F.nullif(F.col(v), F.lit("")) for v in values}
    d = running(slotted(df, keys, order[0], width, large), order, last={f"_f_{v}": c for v, c in own.items()}, after={f"_b_{v}": c for v, c in own.items()})
    return d.withColumns({v: F.coalesce(f"_f_{v}", f"_b_{v}") for v in values}).drop(*[f"_{s}_{v}" for v in values for s in "fb"], SLOT)


def click_anchors(log: DataFrame) -> DataFrame:
    """``session_id, ts_ms, case, source, hint``: the case of each named element, with its label if the row has one."""
    name = strip(F.col("el_name"))
    case, hint = F.regexp_extract(name, LABELLED_ROW, 2), strip(F.regexp_extract(name, LABELLED_ROW, 1))
    one = F.array(F.struct(case.alias("case"), hint.alias("hint")))
    many = F.transform(F.array_distinct(case_ids(name)), lambda c: F.struct(c.alias("case"), F.lit(None).cast("string").alias("hint")))
    rows = log.where("el_name is not null").select("session_id", "ts_ms", F.explode(F.when(name.rlike(LABELLED_ROW), one).otherwise(many)).alias("a"))
    return rows.select("session_id", "ts_ms", "a.case", F.lit("click").alias("source"), "a.hint")


def first_by_source(anchors: DataFrame) -> DataFrame:
    """One anchor per (session, time, case): those of texts come before those of clicks."""
    late = F.col("source") == "click"
    w = Window.partitionBy("session_id", "ts_ms", "case").orderBy(late, F.col("source"), F.col("hint").asc_nulls_last())
    return anchors.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def state_at(units: DataFrame, states: DataFrame, key: str, at: str, order: list[str], value: str, width: int = BUCKET, large: DataFrame | None | str = "count") -> DataFrame:
    """Adds ``value``: that of the last state with a time up to ``at``, the first one's if there is none.

    ``states(key, order..., value)`` in the order of ``order``, whose first column is the time.  One union and one
    shuffle on key and time range.
    """
    left = units.select(key, F.col(at).alias(order[0]), F.struct(*[f"`{c}`" for c in units.columns]).alias("_row"))
    both = left.unionByName(states.select(key, *order, F.struct(F.col(value).alias("v")).alias("_state")), allowMissingColumns=True)
    is_row = F.col("_row").isNotNull()
    turned = [F.desc(order[0]), is_row, *[F.desc(c) for c in order[1:]]]
    found = running(
        slotted(both, [key], order[0], width, large), [order[0], is_row, *order[1:]], last={"_f": F.col("_state")}, after={"_b": F.col("_state")}, reverse=turned, back=[F.col(c) for c in order]
    )
    return found.where(is_row).select("_row.*", F.coalesce("_f.v", "_b.v").alias(value))
