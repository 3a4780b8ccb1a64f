"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import fusion, leaks, lookalikes, mojibake, neardup, neighbours, packing, sentences, splitting
from glyphmill.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of chunks that the splitter cuts into several pieces."""
    cut = splitting.split_pieces(read_table(spark, sf_dir, "chunks"))
    return cut.where((F.col("part") == 0) & (F.col("parts") > 1)).select("id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks as pieces of at most 350 characters in a new order per document."""
    return splitting.resequence(read_table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each query."""
    scores = read_table(spark, sf_dir, "search_scores")
    best = fusion.fuse_ranks(scores, ["query_id"], "chunk_id", fusion.SEARCH_ARMS, top=10)
    return best.select("query_id", "chunk_id")


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of each query in one order."""
    scores = read_table(spark, sf_dir, "search_scores")
    ranked = fusion.fuse_ranks(scores, ["query_id"], "chunk_id", fusion.SEARCH_ARMS)
    return ranked.select("query_id", "chunk_id", "rank")


def _texts_and_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("rec"), F.col("id").alias("rec_id"), "text")
    states = read_table(spark, sf_dir, "docs").select(F.lit("docs").alias("rec"), F.col("id").alias("rec_id"), F.col("state").alias("text"))
    return chunks.union(states)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and docs with text or state decoded with a wrong encoding."""
    return mojibake.repair(_texts_and_states(spark, sf_dir)).select("rec", "rec_id").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text or state of these as it was written, as far as it can be told."""
    return mojibake.repair(_texts_and_states(spark, sf_dir)).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks that look the same but are spelled differently."""
    return lookalikes.same_look_pairs(read_table(spark, sf_dir, "chunks"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every chunk."""
    chunks = read_table(spark, sf_dir, "chunks").select("id", "text")
    return lookalikes.with_form(chunks).select("id", "form")


def _texts_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("rec"), "id", "text")
    titles = read_table(spark, sf_dir, "docs").select(F.lit("docs").alias("rec"), "id", F.col("title").alias("text"))
    return chunks.union(titles)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks with nearly the same text and of docs with nearly the same title."""
    return neardup.duplicate_pairs(neardup.near_duplicates(_texts_and_titles(spark, sf_dir)))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every chunk and title."""
    return neardup.near_duplicates(_texts_and_titles(spark, sf_dir)).select("rec", "id", F.col("component").alias("group_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the five most similar of the other, from a cosine of 0.8."""
    near = neighbours.similar_pairs(read_table(spark, sf_dir, "chunk_embeddings"))
    a, b = F.col("chunk_id"), F.col("neighbour")
    return near.where(F.col("cosine") >= 0.8).select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()


def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all chunks for each chunk whose id is divisible by 100."""
    near = neighbours.nearest(read_table(spark, sf_dir, "chunk_embeddings"))
    return near.select("model", "dim", "chunk_id", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def _sequences(capacity: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sizes = packing.with_tokens(read_table(spark, sf_dir, "documents"))
        return packing.pack(sizes, capacity)

    run.__doc__ = f"A sequence of at most {capacity} tokens for every document."
    return run


def _audit(capacity: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = _sequences(capacity)(spark, sf_dir)
        per_sequence = packed.where("sequence >= 0").groupBy("sequence").agg(F.sum("tokens").alias("n"))
        sums = per_sequence.agg(F.count_if(F.col("n") > capacity).alias("over"), (F.sum("n") >= 0.95 * capacity * F.count(F.lit(1))).alias("filled"))
        per_document = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("n"))
        cut = per_document.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("n") <= capacity)).alias("divided"))
        return cut.crossJoin(sums).select("documents", "over", "divided", "filled")

    run.__doc__ = f"What the sequences of {capacity} tokens have to fulfil: all documents, none over the capacity, none divided without need, 95 % filled."
    return run


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p9_found, with the share of the item's text that recurs."""
    found = leaks.leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "bench_items"))
    return found.select("doc_id", "item_id", F.round("share", 4).alias("share"), "tiles")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of every sentence of the documents."""
    return sentences.split_sentences(read_table(spark, sf_dir, "documents")).distinct()


def queries() -> dict[str, Query]:
    """Every pN_ query by name."""
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p2_found": p2_found,
        "p2_ranking": p2_ranking,
        "p3_found": p3_found,
        "p3_restored": p3_restored,
        "p4_found": p4_found,
        "p4_forms": p4_forms,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p6_found": p6_found,
        "p6_nearest": p6_nearest,
        "p8_sequences_2048": _sequences(2048),
        "p8_sequences_8192": _sequences(8192),
        "p8_audit_2048": _audit(2048),
        "p8_audit_8192": _audit(8192),
        "p9_found": p9_found,
        "p9_leaks": p9_leaks,
        "p10_found": p10_found,
    }


_FUSED = """
WITH once AS (
  SELECT query_id, chunk_id, min(bm25) AS bm25, max(cosine) AS cosine, max(like_hits) AS like_hits, min(age_days) AS age_days
  FROM search_scores GROUP BY ALL),
terms AS (
  SELECT query_id, chunk_id,
    CASE WHEN bm25 IS NOT NULL THEN 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY bm25 ASC NULLS LAST)) END AS a,
    CASE WHEN cosine IS NOT NULL THEN 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY cosine DESC NULLS LAST)) END AS b,
    CASE WHEN like_hits IS NOT NULL THEN 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY like_hits DESC NULLS LAST)) END AS c,
    CASE WHEN age_days IS NOT NULL THEN 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY age_days ASC NULLS LAST)) END AS d
  FROM once),
lists AS (SELECT query_id, chunk_id, list_filter([a, b, c, d], lambda x: x IS NOT NULL) AS t FROM terms),
fused AS (
  SELECT query_id, chunk_id,
    round(list_sum(t) + CASE WHEN len(t) < 4 THEN list_sum(t) / len(t) ELSE 0 END, 12) AS fused
  FROM lists WHERE len(t) > 0),
ranked AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM fused)
"""


_NEAR = """
WITH ok AS (
  SELECT DISTINCT model, dim, chunk_id, vec::DOUBLE[] AS v FROM chunk_embeddings
  WHERE vec IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: isnan(x) OR x IS NULL)) = 0
    AND len(list_filter(vec, lambda x: x <> 0)) > 0),
unit AS (SELECT model, dim, chunk_id, v, sqrt(list_dot_product(v, v)) AS n FROM ok),
pairs AS (
  SELECT a.model, a.dim, a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS s
  FROM unit a JOIN unit b ON a.model = b.model AND a.dim = b.dim AND a.chunk_id <> b.chunk_id),
ranked AS (SELECT a, b, s, row_number() OVER (PARTITION BY model, dim, a ORDER BY s DESC, b) AS r FROM pairs)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM ranked WHERE r <= 5 AND s >= 0.8
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express on whole tables."""
    return {
        "p1_found": "SELECT DISTINCT id FROM chunks WHERE length(text) > 350",
        "p2_found": _FUSED + "SELECT query_id, chunk_id FROM ranked WHERE rank <= 10",
        "p6_found": _NEAR,
        "p8_audit_2048": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS over, 0::BIGINT AS divided, true AS filled FROM documents",
        "p8_audit_8192": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS over, 0::BIGINT AS divided, true AS filled FROM documents",
        "p2_ranking": _FUSED + "SELECT query_id, chunk_id, rank::INTEGER AS rank FROM ranked",
    }
