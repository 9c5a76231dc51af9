"""Text functions: identifiers, routes and amounts in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of a case identifier, of a route in a hash url, and of an amount in yen.
CASE_ID = r"(?U)\b[A-Z]{1,6}\d*-\d{2,10}-\d{1,6}\b"
ROUTE = r"(?U)#/([\w-]+)"
YEN = r"([\d,]+)\s*円"


def case_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CASE_ID), F.lit(0))


def case_prefix(case: Column) -> Column:
    return F.substring_index(case, "-", 1)


def url_route(url: Column) -> Column:
    """The route of a hash url, null without one."""
    return F.nullif(F.regexp_extract(url, ROUTE, 1), F.lit(""))


def element_prefix(element: Column) -> Column:
    """``btn-x-y`` gives x, any other name its head before the first hyphen."""
    parts = F.split(element, "-")
    return F.when(element.startswith("btn-"), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def yen(text: Column) -> Column:
    """The amount before 円, with its commas removed; null if there is none."""
    digits = F.regexp_extract(text, YEN, 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("bigint")


# Field names of a raw record, the longest payload, and the forms of identifiers.
RAW_FIELDS = ("event_id", "timestamp_ms", "schema_version", "correlation", "username_hash", "machine_id", "active_browser_tab")
LONGEST_PAYLOAD = 20_000
SESSION_ID, ROW_ID = r"\bses_\d{8}-\d{6}", r"\b[A-Z]{1,6}\d*-\d{2,10}-\d{1,6}\b"


def payload_refusal(text: Column) -> Column:
    """Why a text may not leave: its length, the first raw field that it names in quotes, or an identifier; null if it may."""
    reason = F.when(F.length(text) > LONGEST_PAYLOAD, F.lit("too long"))
    for field in RAW_FIELDS:
        reason = reason.when(F.contains(text, F.lit(f'"{field}"')), F.lit(f"raw field {field}"))
    return reason.when(text.rlike(SESSION_ID) | text.rlike(ROW_ID), F.lit("identifier"))
