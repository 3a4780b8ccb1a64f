"""Checks of the index: each is one relational query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.vectors import norm_check


def chunks_without_vector(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunk ids that no vector belongs to."""
    return chunks.select("chunk_id").distinct().join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def vectors_without_chunk(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunk ids of vectors whose chunk is gone."""
    return vectors.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def backfill(chunks: DataFrame, vectors: DataFrame, docs_per_run: int = 400) -> DataFrame:
    """Chunks without vector of the first ``docs_per_run`` documents that have any."""
    missing = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    some = missing.select("doc_id").distinct().orderBy("doc_id").limit(docs_per_run)
    return missing.join(some, "doc_id", "left_semi")


def wrong_dims(vectors: DataFrame) -> DataFrame:
    """(model, dim, n) of vectors whose length is not dim."""
    bad = vectors.where(F.col("vec").isNull() | (F.size("vec") != F.col("dim")))
    return bad.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n"))


def chunk_count_errors(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, found): indexed documents whose stored number of chunks is not what there is."""
    counts = chunks.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("found"))
    rows = docs.where(F.col("state") == "indexed").select("doc_id", "n_chunks").join(counts, "doc_id", "left")
    rows = rows.withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.where(~F.col("n_chunks").eqNullSafe(F.col("found")))


def changed_texts(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Chunk ids whose indexed text (chunk_id, h: its hash) is not the chunk's."""
    now = chunks.select("chunk_id", F.xxhash64("text").alias("now"))
    return now.join(indexed.select("chunk_id", "h"), "chunk_id").where(F.col("now") != F.col("h")).select("chunk_id").distinct()


def index_health(chunks: DataFrame, indexed: DataFrame, postings: DataFrame) -> DataFrame:
    """(name, bad): how the full-text index and the chunks differ."""
    ids = lambda df: df.select("chunk_id").distinct()
    checks = {
        "chunks_not_indexed": ids(chunks).join(ids(indexed), "chunk_id", "left_anti"),
        "indexed_without_chunk": ids(indexed).join(ids(chunks), "chunk_id", "left_anti"),
        "postings_without_chunk": ids(postings).join(ids(chunks), "chunk_id", "left_anti"),
        "indexed_text_differs": changed_texts(chunks, indexed),
    }
    return reduce(DataFrame.union, [rows.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("name"), "bad") for name, rows in checks.items()])


def length_errors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_chars, length) where the stored length is missing or wrong."""
    return chunks.where(~F.col("n_chars").eqNullSafe(F.length("text"))).select("chunk_id", "n_chars", F.length("text").alias("length")).distinct()


def health(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, bad): all checks with the number of offending rows."""
    def count(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("name"), "bad")

    checks = [
        count("chunks_without_vector", chunks_without_vector(chunks, vectors)),
        count("vectors_without_chunk", vectors_without_chunk(chunks, vectors)),
        count("chunk_count", chunk_count_errors(docs, chunks)),
        count("text_length", length_errors(chunks)),
        wrong_dims(vectors).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad")).select(F.lit("wrong_dims").alias("name"), "bad"),
        vectors.agg(F.countDistinct("model", "dim").alias("k")).select(F.lit("further_models").alias("name"), F.greatest(F.col("k") - 1, F.lit(0)).alias("bad")),
        norm_check(vectors).select(F.lit("norms").alias("name"), F.col("off").alias("bad")),
    ]
    return reduce(DataFrame.union, checks)
