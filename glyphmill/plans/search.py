"""The hybrid search: both arms, fusion, filters, cap, order and projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import snippet
from glyphmill.operators.fulltext import TextIndex, bm25_scan, has_content, like_fallback
from glyphmill.operators.ranking import arm_ranks, fuse_arms
from glyphmill.operators.vectors import Embedder, vector_top


@dataclass
class Result:
    """Rows of a search and what there is to say about it: the arms that hit, notes, hits left out by the cap per document."""

    rows: DataFrame
    mode: str
    notes: list[str] = field(default_factory=list)
    suppressed: int = 0
    arms: dict[str, int] = field(default_factory=dict)


def doc_filter(docs: DataFrame, source: str | None = None, date_from: str | None = None, date_to: str | None = None, include_dead: bool = False) -> DataFrame:
    """Documents by state, source and date; dates are compared as text, an unknown date ('') is before all."""
    out = docs if include_dead else docs.where(F.col("state") == "indexed")
    if source:
        out = out.where(F.col("source_id") == source)
    if date_from:
        out = out.where(F.col("date") >= date_from)
    if date_to:
        out = out.where(F.col("date") <= date_to)
    return out


def search(
    docs: DataFrame,
    chunks: DataFrame,
    query: str,
    vectors: DataFrame | None = None,
    embedder: Embedder | None = None,
    mode: str = "hybrid",
    top_k: int = 8,
    sort: str = "relevance",
    source: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    max_per_doc: int = 2,
    k: int = 60,
    candidates: int = 200,
    query_vector: list[float] | None = None,
    index: TextIndex | None = None,
    query_prefix: str = "",
) -> Result:
    """Search ``chunks`` (chunk_id, doc_id, seq, text) of ``docs`` (doc_id, source_id, title, date, state, rel_path).

    BM25 statistics are those of all chunks; filters act before an arm's candidates are
    taken. With an ``index`` of the chunks no text is read but those of the results. Where
    no filtered chunk matches a phrase, chunks that hold the query itself are taken in the
    order of their id. The vector arm looks at the model of most vectors; a query that is
    encoded here gets ``query_prefix``. Results are ordered by fused score, then chunk id;
    ``recent`` orders by date first. An unknown source gives a note and no rows.

    Each arm's candidates, at most ``candidates`` rows without text, come to the driver:
    the mode is that of the arms that hit, and what follows them is small.
    """
    notes: list[str] = []
    spark, top_k = chunks.sparkSession, max(1, min(50, top_k))
    wanted = doc_filter(docs, source, date_from, date_to)
    if source and docs.where(F.col("source_id") == source).isEmpty():
        notes.append(f"unknown source {source!r}")
    meta = wanted.select("doc_id", "source_id", "title", "date", "rel_path")
    allowed = chunks.join(meta.select("doc_id"), "doc_id", "left_semi")
    if not has_content(query):
        return Result(_projected(spark, [], [], chunks, meta, k, [], top_k, 0)[0], "empty", ["the query holds no letter or digit"])
    fts: list = []
    if mode in ("hybrid", "fts"):
        best = lambda rows: arm_ranks(rows.select("chunk_id", "doc_id", "bm25"), [F.asc("bm25"), F.asc("chunk_id")], candidates, "fts_rank").collect()
        scored = index.bm25(query) if index is not None else bm25_scan(chunks, query)
        fts = best(scored.join(meta.select("doc_id"), "doc_id", "left_semi"))
        if not fts:
            fts = best(like_fallback(allowed, query))
            notes.append("no phrase matched; the query itself was looked for")
    vec: list = []
    if mode in ("hybrid", "vector"):
        if query_vector is None and embedder is not None and embedder.available:
            query_vector = [float(x) for x in embedder.encode([query], query_prefix)[0]]
        if vectors is None or query_vector is None:
            notes.append("vectors are not available: " + (embedder.reason if embedder is not None else "no embedder"))
        else:
            owners = index.owners if index is not None else chunks.select("chunk_id", "doc_id")
            own = owners.join(meta.select("doc_id"), "doc_id", "left_semi").select("chunk_id")
            near = vector_top(vectors.join(own, "chunk_id", "left_semi"), query_vector, candidates, every=vectors)
            near = owners.join(F.broadcast(near), "chunk_id").distinct()  # at most ``candidates`` rows
            vec = arm_ranks(near, [F.desc("cosine"), F.asc("chunk_id")], candidates, "vector_rank").collect()
    if sort not in ("relevance", "recent"):
        notes.append(f"unknown sort {sort!r}; relevance is used")
    order = [F.desc("date")] if sort == "recent" else []
    rows, suppressed = _projected(spark, fts, vec, chunks, meta, k, order, top_k, max_per_doc)
    hit = "hybrid" if fts and vec else "fts" if fts else "vector" if vec else f"{mode}(no-hit)"
    both = {r["chunk_id"] for r in fts} & {r["chunk_id"] for r in vec}
    return Result(rows, hit, notes, suppressed, {"both": len(both), "fts": len(fts) - len(both), "vector": len(vec) - len(both)})


def _projected(spark, fts: list, vec: list, chunks: DataFrame, meta: DataFrame, k: int, order: list, top_k: int, max_per_doc: int) -> tuple[DataFrame, int]:
    """(the first ``top_k`` hits with their metadata, hits left out by the cap before these were full).

    Of the two arms' rows, at most 400, the first by score keep their metadata; the texts
    of at most 50 chunks are read, by their ids.
    """
    left = spark.createDataFrame([(r["chunk_id"], r["doc_id"], r["fts_rank"]) for r in fts], "chunk_id long, doc_id long, fts_rank int")
    right = spark.createDataFrame([(r["chunk_id"], r["doc_id"], r["vector_rank"], r["cosine"]) for r in vec], "chunk_id long, doc_id long, vector_rank int, cosine double")
    owner = left.select("chunk_id", "doc_id").union(right.select("chunk_id", "doc_id")).distinct()
    fused = fuse_arms(left, right, k).orderBy(F.desc("score"), "chunk_id").limit(max(8 * top_k, 200)).join(owner, "chunk_id")
    order = [*order, F.desc("score"), F.asc("chunk_id")]
    known = arm_ranks(meta.join(F.broadcast(fused), "doc_id"), order, max(8 * top_k, 200), "place").collect() if fts or vec else []
    kept, taken, suppressed = [], {}, 0
    for r in known:
        if len(kept) == top_k:
            break
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
        if 0 < max_per_doc < taken[r["doc_id"]]:
            suppressed += 1
        else:
            kept.append((len(kept) + 1, *[r[c] for c in ("score", "doc_id", "chunk_id", "title", "date", "source_id", "rel_path", "fts_rank", "vector_rank", "cosine")]))
    schema = "rank int, score double, doc_id long, chunk_id long, title string, date string, source_id string, rel_path string, fts_rank int, vector_rank int, cosine double"
    hits = spark.createDataFrame(kept, schema)
    texts = chunks.where(F.col("chunk_id").isin([r[3] for r in kept])).select("chunk_id", "doc_id", "seq", "text")
    return hits.join(texts, ["chunk_id", "doc_id"]).select(
        "rank", F.round("score", 6).alias("score"), "doc_id", "chunk_id", "seq", "title", "date", F.col("source_id").alias("source"),
        F.col("rel_path").alias("path"), F.length("text").alias("chars"), "fts_rank", "vector_rank", F.round("cosine", 4).alias("cosine"),
        snippet(F.col("text")).alias("snippet"),
    ).orderBy("rank"), suppressed
