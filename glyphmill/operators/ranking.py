"""Ranks, reciprocal rank fusion of two arms, caps per document, order and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arm_ranks(arm: DataFrame, order: list[Column], limit: int, out: str) -> DataFrame:
    """The best ``limit`` rows of an arm with their 1-based rank in ``out``.

    The limit comes first, so the window without a partition sees at most ``limit`` rows.
    """
    return arm.orderBy(*order).limit(limit).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def fuse_arms(fts: DataFrame, vec: DataFrame, k: int = 60) -> DataFrame:
    """(chunk_id, fts_rank, vector_rank, cosine, score): the sum of 1/(k+rank) over both arms."""
    both = fts.select("chunk_id", "fts_rank").join(vec.select("chunk_id", "vector_rank", "cosine"), "chunk_id", "full_outer")
    term = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.withColumn("score", term("fts_rank") + term("vector_rank"))


def cap_per_document(hits: DataFrame, order: list[Column], most: int, doc_col: str = "doc_id") -> DataFrame:
    """At most ``most`` rows per document in ``order`` (all if ``most`` is 0 or less)."""
    if most <= 0:
        return hits
    place = F.row_number().over(Window.partitionBy(doc_col).orderBy(*order))
    return hits.withColumn("__p", place).where(F.col("__p") <= most).drop("__p")


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """``limit`` rows after the first ``offset`` of ``rows`` in ``order``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))
