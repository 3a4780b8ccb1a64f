"""Cleaning, front-matter, metadata and classification of documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and markers of junk and dead documents.
PRIVATE_USE = r"[\x{E000}-\x{F8FF}]"
JUNK_MARKERS = ("锛", "鏃ユ湡", "璇煶杞綍")
JUNK_DATE = r"^\s*@\{page=.*?\}\s*\.?\s*date\)?\s*$"
JUNK_ID = r"(?i)^\s*BVID\b[^\n]{0,4}bvid\s*$"
HEADING = r"^\s{0,3}#{1,6}\s*(.*?)\s*#*\s*$"
KEY_LINE = r"^([A-Za-z_][A-Za-z0-9_\-]*)\s*:\s*(.*)$"
API_ERRORS = (
    r"(?i)upstream_error|invalid_request_error|Request Entity Too Large|Bad Gateway|Gateway Time-?out|"
    r"Service Unavailable|Internal Server Error"
)
HTML = r"(?i)<html|<!doctype"
JSON_ERROR_STARTS = ('{"error"', '{\n  "error"', "{'error'")
QUOTE_MARKS = "\"'“”‘’"
DEAD_STATUSES = ("dead", "error", "failed")
TITLE_CHARS = 300

_WS = r"(?U)\s"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def strip_bom(c: Column) -> Column:
    """Without leading byte order marks."""
    return F.regexp_replace(c, "^\\uFEFF+", "")


def normalize_newlines(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def unquote(c: Column) -> Column:
    """Stripped, and without an equal pair of quote characters around it."""
    s = stripped(c)
    return F.when(s.rlike(rf"(?s)^([{QUOTE_MARKS}]).*\1$") & (F.length(s) >= 2), stripped(s.substr(F.lit(2), F.length(s) - 2))).otherwise(s)


def with_front_matter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``meta`` (map), ``body_raw`` and ``has_meta``, parsed from its front-matter.

    Front-matter stands between a first line '---' and the next such line; keys are
    lower-cased, of a repeated key the last counts; without a closing line the whole
    text is the body. Null gives an empty body. Each step is a column of its own, so
    that Catalyst evaluates it once.
    """
    rows = df.withColumn("__s", F.coalesce(normalize_newlines(strip_bom(F.col(text_col))), F.lit("")))
    opens = F.col("__s").rlike(r"\A[^\S\n]*---[^\S\n]*\n")
    rows = rows.withColumn("__rest", F.when(opens, F.regexp_replace("__s", r"\A[^\n]*\n", "")))
    rows = rows.withColumn("__at", F.coalesce(F.regexp_instr("__rest", F.lit(r"(?m)^---[^\S\n]*$")), F.lit(0)))
    found = F.col("__at") > 0
    head = F.when(found, F.col("__rest").substr(F.lit(1), F.col("__at") - 1)).otherwise("")
    tail = F.regexp_replace(F.col("__rest").substr(F.col("__at"), F.length("__rest")), r"\A---[^\S\n]*\n?", "")
    rows = rows.withColumn("__lines", F.filter(F.split(head, "\n"), lambda x: x.rlike(KEY_LINE)))
    rows = rows.withColumn("__keys", F.transform("__lines", lambda x: F.lower(F.regexp_extract(x, KEY_LINE, 1))))
    rows = rows.withColumn("__values", F.transform("__lines", lambda x: unquote(F.regexp_extract(x, KEY_LINE, 2))))
    last = lambda k: F.element_at("__values", (F.size("__keys") - F.array_position(F.reverse("__keys"), k) + 1).cast("int"))
    own = F.array_distinct("__keys")
    rows = rows.withColumn("meta", F.map_from_arrays(own, F.transform(own, last)))
    rows = rows.withColumn("body_raw", F.when(found, tail).otherwise(F.col("__s"))).withColumn("has_meta", found)
    return rows.drop("__s", "__rest", "__at", "__lines", "__keys", "__values")


def junk_reason(line: Column, title: Column) -> Column:
    """Why a line is junk, or null."""
    marker = F.lit(False)
    for m in JUNK_MARKERS:
        marker = marker | F.contains(line, F.lit(m))
    heading = stripped(F.regexp_extract(line, HEADING, 1))
    return (
        F.when(stripped(line) == "", F.lit(None))
        .when(line.rlike(PRIVATE_USE) | marker, "gbk_mojibake")
        .when(line.rlike(JUNK_DATE), "junk_header_date")
        .when(line.rlike(JUNK_ID), "junk_header_id")
        .when((F.length(stripped(title)) > 0) & line.rlike(HEADING) & (heading == stripped(title)), "duplicate_title_heading")
    )


def clean_body(body: Column, title: Column, enabled: bool = True) -> Column:
    """Body without junk lines, blanks at line ends and runs of blank lines, stripped."""
    if not enabled:
        return stripped(body)
    lines = F.split(normalize_newlines(strip_bom(body)), "\n")
    kept = F.filter(lines, lambda x: junk_reason(x, title).isNull())
    text = F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, rf"{_WS}+$", "")), "\n")
    return stripped(F.regexp_replace(text, "\n{3,}", "\n\n"))


def junk_counts(body: Column, title: Column) -> Column:
    """Struct of the numbers of junk lines: mojibake, header, heading."""
    reasons = F.transform(F.split(normalize_newlines(strip_bom(body)), "\n"), lambda x: junk_reason(x, title))
    n = lambda *names: F.size(F.filter(reasons, lambda r: r.isin(*names)))
    return F.struct(
        n("gbk_mojibake").alias("mojibake"), n("junk_header_date", "junk_header_id").alias("header"), n("duplicate_title_heading").alias("heading")
    )


def dead_reason(body: Column, status: Column) -> Column:
    """Why a document is dead, or null: first match of the checks."""
    s = stripped(F.coalesce(body, F.lit("")))
    starts = F.lit(False)
    for j in JSON_ERROR_STARTS:
        starts = starts | F.startswith(s, F.lit(j))
    return (
        F.when(s == "", "empty_body")
        .when(s.substr(1, 1500).rlike(API_ERRORS), "api_error_body")
        .when((F.length(s) < 4000) & s.substr(1, 400).rlike(HTML), "html_error_body")
        .when(starts, "json_error_body")
        .when(F.lower(stripped(F.coalesce(status, F.lit("")))).isin(*DEAD_STATUSES), "status_marked_dead")
    )


def state_of(reason: Column, body: Column, min_chars: int = 30) -> Column:
    """dead, empty or indexed."""
    return F.when(reason.isNotNull(), "dead").when(F.length(F.coalesce(body, F.lit(""))) < min_chars, "empty").otherwise("indexed")


def file_name_id(name: Column, prefix: str = "talk-") -> Column:
    """External id in a file name: what stands between ``prefix`` and '.md', else ''."""
    return F.regexp_extract(F.regexp_replace(name, r"(?i)\.md$", ""), rf"^\Q{prefix}\E(.*)$", 1)


def first_heading(body: Column) -> Column:
    """Text of the first heading that has one, else null."""
    heads = F.filter(F.transform(F.split(body, "\n"), lambda x: stripped(F.regexp_extract(x, HEADING, 1))), lambda h: h != "")
    return F.get(heads, 0)


def meta_fields(meta: Column, body: Column, name: Column, prefix: str = "talk-") -> dict[str, Column]:
    """Normalised fields of both generations of headers: title, ext_id, date, duration, vtype, status."""
    value = lambda k: stripped(F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")))
    some = lambda c: F.when(c != "", c)
    described = stripped(F.regexp_replace(value("description"), r"\s*[（(]\d{4}-\d{2}-\d{2}[)）]\s*$", ""))
    own_id = file_name_id(name, prefix)
    title = F.coalesce(some(value("title")), some(described), first_heading(body), some(value("name")), some(own_id), name)
    return {
        "title": title.substr(1, TITLE_CHARS),
        "ext_id": F.coalesce(some(value("bvid")), own_id),
        "date": F.coalesce(some(value("date")), F.regexp_extract(value("description"), r"\d{4}-\d{2}-\d{2}", 0)),
        "duration": value("duration"),
        "vtype": value("type"),
        "status": value("status"),
    }


def snippet(c: Column, n: int = 240) -> Column:
    """White space folded, cut to ``n`` characters with an ellipsis."""
    s = stripped(F.regexp_replace(c, rf"{_WS}+", " "))
    return F.when(F.length(s) > n, F.concat(s.substr(1, n), F.lit("…"))).otherwise(s)


def junk_scan(c: Column) -> Column:
    """Struct of the numbers of lines with private-use characters and with markers."""
    lines = F.split(c, "\n")
    marked = lambda x: F.contains(x, F.lit(JUNK_MARKERS[0])) | F.contains(x, F.lit(JUNK_MARKERS[1])) | F.contains(x, F.lit(JUNK_MARKERS[2]))
    return F.struct(F.size(F.filter(lines, lambda x: x.rlike(PRIVATE_USE))).alias("private_use"), F.size(F.filter(lines, marked)).alias("markers"))
