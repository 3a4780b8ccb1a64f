"""Overlapping chunks of document bodies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a chunk's end in which a line break is preferred.
BREAK_WINDOW = 60


def chunk_spans(text: str, size: int, overlap: int, least: int) -> list[str]:
    """Chunks of one text, each at most ``size`` characters, sharing ``overlap`` with the one before."""
    n = len(text)
    if n <= size:
        whole = text.strip()
        return [whole] if whole else []
    out, start = [], 0
    while start < n:
        end = min(n, start + size)
        if end < n:
            line = text.rfind("\n", max(start + 1, end - BREAK_WINDOW), end)
            end = line if line > 0 else end
        piece = text[start:end].strip()
        if piece and (len(piece) >= least or not out) and (not out or out[-1] != piece):
            out.append(piece)
        if end >= n:
            break
        start = end - overlap if end - overlap > start else start + size - overlap
    return out


def chunk_array(body: Column, size: int = 350, overlap: int = 80, least: int = 20) -> Column:
    """Array of the chunks of a body; [] for null and blank. Bodies within ``size`` stay in the JVM."""

    @F.pandas_udf("array<string>")
    def cut(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda t: [] if t is None else chunk_spans(t, size, overlap, least))

    whole = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    short = F.when(F.coalesce(whole, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    return F.when(F.length(body) > size, cut(F.when(F.length(body) > size, body))).otherwise(short)


def chunk_documents(docs: DataFrame, size: int = 350, overlap: int = 80, id_col: str = "doc_id", body_col: str = "body") -> DataFrame:
    """(doc_id, seq, text, n_chars): a row per chunk, seq from 0."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunk_array(F.col(body_col), size, overlap)).alias("seq", "text"))
    return cut.select("doc_id", "seq", "text", F.length("text").alias("n_chars"))
