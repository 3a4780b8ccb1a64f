"""Problem 1: splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.numbering import BUCKET, bucket_offsets

#: Rows of one document that are numbered by one task.
SEQ_BUCKET = 1024

# Marks after which a text pauses, strongest first.
SENTENCE_MARKS = "。！？!?…．｡"
CLAUSE_MARKS = "，、；：,;:—"
CLOSERS = "”’」』）】》〉)]}\"'"

_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)+")
_SENTENCE = re.compile(rf"(?:[{SENTENCE_MARKS}]+|\.+(?=[\s{re.escape(CLOSERS)}]|$))[{re.escape(CLOSERS)}]*")
_CLAUSE = re.compile(rf"[{CLAUSE_MARKS}]+[{re.escape(CLOSERS)}]*")
_BLANK = re.compile(r"\s+")
_LATIN_WORD = re.compile(r"[^\W_\u0e00-\u0effᄀ-ᇿ⺀-\U0003ffff]+")

PIECES = T.ArrayType(
    T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("text", T.StringType())])
)


def _glued(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would part what is shown as one character."""
    before, after = text[at - 1], text[at]
    if before == "\r" and after == "\n" or before == "\u200d" or after in "\u200d\ufe0e\ufe0f":
        return True
    if "\U0001f3fb" <= after <= "\U0001f3ff":
        return True
    return after > "˿" and unicodedata.category(after) in ("Mn", "Mc", "Me")


def token_offsets(text: str) -> list[int]:
    """Prefix sums of token lengths: the places where a cut parts no word and no character.

    Words of letters written with blanks between them are one token, every other
    character with its marks is one.
    """
    offsets, at = [0], 0
    for word in _LATIN_WORD.finditer(text):
        offsets.extend(k for k in range(at + 1, word.start() + 1) if not _glued(text, k))
        at = word.end()
        if at < len(text) and not _glued(text, at) or at == len(text):
            offsets.append(at)
    offsets.extend(k for k in range(at + 1, len(text)) if not _glued(text, k))
    if offsets[-1] != len(text):
        offsets.append(len(text))
    return offsets


def boundary_offsets(text: str) -> list[list[int]]:
    """Sorted ends of pauses by strength: sentences and lines, clauses, blanks."""
    strong = sorted({m.end() for rx in (_PARAGRAPH, _SENTENCE) for m in rx.finditer(text)})
    strong = [k for k in strong if not (k < len(text) and text[k] in "\r\n")]
    return [strong, [m.end() for m in _CLAUSE.finditer(text)], [m.end() for m in _BLANK.finditer(text)]]


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``: none longer than ``limit``.

    Each piece ends at the last pause of the strongest kind in its second half,
    else at the last pause that still leaves progress, else between two tokens,
    else hard at the limit. The next piece starts at the last token boundary that
    is at least ``overlap`` before that end.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    tokens, levels, spans, start = token_offsets(text), boundary_offsets(text), [], 0
    while True:
        top = start + limit
        if top >= n:
            spans.append((start, n))
            return spans
        end = 0
        for floor in (start + max(overlap, limit // 2), start + overlap):
            for marks in (*levels, tokens):
                k = bisect_right(marks, top)
                if k and marks[k - 1] > floor and (marks is not tokens or floor == start + overlap):
                    end = marks[k - 1]
                    break
            if end:
                break
        if not end:
            end = top
        spans.append((start, end))
        k = bisect_right(tokens, end - overlap)
        back = tokens[k - 1] if k else 0
        start = back if back > start else max(end - overlap, start + 1)


def pieces(text: Column, limit: int = 350, overlap: int = 80) -> Column:
    """Array of (start_pos, text) of each text; null for null.

    Only texts over ``limit`` code points are sent to Python; the others are
    one piece, made in the JVM. '' is one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")

    @F.pandas_udf(PIECES)
    def cut_long(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else [(a, t[a:b]) for a, b in cut_points(t, limit, overlap)]
        )

    # marked so that the optimizer does not copy the call into each use of the pieces
    cut_once = cut_long.asNondeterministic()
    whole = F.array(F.struct(F.lit(0).alias("start_pos"), text.alias("text")))
    long = F.when(F.length(text) > limit, text)
    return F.when(F.length(text) > limit, cut_once(long)).when(text.isNotNull(), whole)


def split_pieces(
    chunks: DataFrame,
    limit: int = 350,
    overlap: int = 80,
    id_col: str = "id",
    text_col: str = "text",
) -> DataFrame:
    """(id, part, parts, start_pos, text, n_chars), a row per piece of every row.

    A null text gives no piece. ``part`` counts from 0. Other columns, whatever
    their names, are not read; equal rows give equal pieces.
    """
    rows = chunks.select(F.col(id_col).alias("id"), pieces(F.col(text_col), limit, overlap).alias("__p"))
    cut = rows.select("id", F.size("__p").alias("parts"), F.posexplode("__p").alias("part", "__s"))
    return cut.select(
        "id", "part", "parts", F.col("__s.start_pos").alias("start_pos"), F.col("__s.text").alias("text"),
        F.length("__s.text").alias("n_chars"),
    )


def resequence(chunks: DataFrame, limit: int = 350, overlap: int = 80) -> DataFrame:
    """All chunks of (id, doc_id, seq, text) as pieces with a new seq per document.

    (doc_id, seq, chunk_id, start_pos, text, n_chars): seq counts from 0 in the
    order of old seq, id and place. Rows repeated with the same id and text count
    once; null texts are left out; a null old seq comes first. A document of any
    length is numbered in buckets of SEQ_BUCKET old seq values.
    """
    rows = chunks.select("id", "doc_id", F.col("seq").alias("old"), "text").where(F.col("text").isNotNull())
    rows = rows.withColumn(BUCKET, F.coalesce(F.floor(F.col("old") / SEQ_BUCKET), F.lit(-(1 << 40))))
    once = rows.withColumn("h", F.xxhash64("text")).repartition("doc_id", BUCKET)
    once = once.dropDuplicates(["doc_id", BUCKET, "old", "id", "h"])
    cut = once.select("id", "doc_id", "old", "h", BUCKET, F.posexplode(pieces(F.col("text"), limit, overlap)).alias("part", "s"))
    order = [F.asc_nulls_first("old"), F.asc_nulls_first("id"), F.col("h"), F.col("part")]
    placed = cut.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", BUCKET).orderBy(*order)))
    counts = cut.groupBy("doc_id", BUCKET).agg(F.count(F.lit(1)).alias("n"))
    offsets = bucket_offsets(counts, ["doc_id"], "n").select(
        F.col("doc_id").alias("o_doc"), F.col(BUCKET).alias("o_bucket"), "__offset"
    )
    on = F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col(BUCKET) == F.col("o_bucket"))
    return placed.join(offsets, on).select(
        "doc_id",
        (F.col("at") + F.col("__offset") - 1).alias("seq"),
        F.col("id").alias("chunk_id"),
        F.col("s.start_pos").alias("start_pos"),
        F.col("s.text").alias("text"),
        F.length("s.text").alias("n_chars"),
    )
