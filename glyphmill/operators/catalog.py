"""Listing, fetching, counting: the catalogue of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ranking import page
from glyphmill.plans.search import doc_filter

# Orders of a listing.
ORDERS = ("date_desc", "date_asc", "title")


def listing_order(order: str) -> list[Column]:
    """Columns of an order; an unknown one is date_desc."""
    if order == "date_asc":
        return [F.asc("date"), F.asc("doc_id")]
    if order == "title":
        return [F.asc("title"), F.asc("doc_id")]
    return [F.desc("date"), F.desc("doc_id")]


def list_documents(
    docs: DataFrame, source: str | None = None, date_from: str | None = None, date_to: str | None = None,
    title_contains: str | None = None, id_contains: str | None = None, include_dead: bool = False,
    order: str = "date_desc", limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of documents. ``title_contains`` and ``id_contains`` are taken literally, without regard to case."""
    rows = filtered_documents(docs, source, date_from, date_to, title_contains, id_contains, include_dead)
    return page(rows, listing_order(order), limit, offset)


def filtered_documents(
    docs: DataFrame, source: str | None = None, date_from: str | None = None, date_to: str | None = None,
    title_contains: str | None = None, id_contains: str | None = None, include_dead: bool = False,
) -> DataFrame:
    """All documents that a listing pages through; their count is its total."""
    rows = doc_filter(docs, source, date_from, date_to, include_dead)
    for column, part in (("title", title_contains), ("bvid", id_contains)):
        if part:
            rows = rows.where(F.contains(F.lower(column), F.lit(part.lower())))
    return rows


def latest_by_id(docs: DataFrame, ext_id: str) -> DataFrame:
    """The document of an external id (column ext_id or bvid) with the latest date; ties go to the larger id."""
    return docs.where(F.col("ext_id" if "ext_id" in docs.columns else "bvid") == ext_id).orderBy(F.desc("date"), F.desc("doc_id")).limit(1)


def by_path(docs: DataFrame, path: str) -> DataFrame:
    """The document whose path is or ends with ``path``; of several the first by path."""
    return docs.where((F.col("rel_path") == path) | F.endswith(F.col("rel_path"), F.lit(path))).orderBy("rel_path", "doc_id").limit(1)


def fetch_window(rows: DataFrame, offset: int = 0, max_chars: int = 20_000, anchor: Column | None = None) -> DataFrame:
    """(doc_id, total_chars, offset, returned_chars, has_more, text) of ``rows`` (doc_id, body).

    With an ``anchor`` (the first characters of a chunk) that is found, the window begins
    a little before it: a third of the window, 120 characters at most.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    start = F.lit(max(0, offset))
    if anchor is not None:
        at = F.instr(body, anchor)
        start = F.when(at > 0, F.greatest(at - 1 - min(120, max_chars // 3), F.lit(0))).otherwise(start)
    text = F.substring(body, start + 1, F.lit(max_chars))
    return rows.select(
        "doc_id", F.length(body).alias("total_chars"), start.alias("offset"), F.length(text).alias("returned_chars"),
        (start + F.length(text) < F.length(body)).alias("has_more"), text.alias("text"),
    )


def fetch(
    docs: DataFrame, chunks: DataFrame | None = None, chunk_id: int | None = None, doc_id: int | None = None,
    path: str | None = None, ext_id: str | None = None, offset: int = 0, max_chars: int = 20_000,
) -> DataFrame:
    """A window of one document (``docs`` with doc_id, rel_path and body), named by a chunk, an id, a path or an external id.

    With a chunk the window begins a little before it. No row for a name that is unknown.
    """
    max_chars = max(1, max_chars)
    if chunk_id is not None:
        if chunks is None:
            raise ValueError("a chunk is named, but no chunks are given")
        # one row, so it is the small side of the join
        one = chunks.where(F.col("chunk_id") == chunk_id).select("doc_id", F.substring("text", 1, 60).alias("__anchor")).orderBy("doc_id", "__anchor").limit(1)
        return fetch_window(docs.join(F.broadcast(one), "doc_id"), 0, max_chars, F.col("__anchor"))
    if doc_id is not None:
        return fetch_window(docs.where(F.col("doc_id") == doc_id), offset, max_chars)
    if path:
        return fetch_window(by_path(docs, path), offset, max_chars)
    if ext_id:
        return fetch_window(latest_by_id(docs, ext_id), offset, max_chars)
    raise ValueError("name a chunk, a document, a path or an external id")


def corpus_counts(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: documents by state, chunks and vectors."""
    d = docs.agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("state") == "indexed").alias("indexed"),
        F.count_if(F.col("state") == "dead").alias("dead"), F.count_if(F.col("state") == "empty").alias("empty"),
    )
    return d.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(vectors.agg(F.count(F.lit(1)).alias("vectors")))


def state_counts(docs: DataFrame) -> DataFrame:
    """(state, n)."""
    return docs.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def source_summary(docs: DataFrame) -> DataFrame:
    """(source_id, files, newest, oldest, bytes, dead) per source."""
    return docs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("files"), F.max("mtime").alias("newest"), F.min("mtime").alias("oldest"),
        F.sum("size").alias("bytes"), F.count_if(F.col("state") == "dead").alias("dead"),
    )
