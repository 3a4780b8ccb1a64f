"""From texts to documents and chunks: parse, clean, classify, chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import clean_body, dead_reason, junk_counts, meta_fields, state_of, with_front_matter
from glyphmill.operators.chunking import chunk_array


def parse_documents(texts: DataFrame, clean: bool = True, min_chars: int = 30) -> DataFrame:
    """``texts`` (source_id, rel_path, file_name, text) as documents with metadata, clean body, state and reason.

    A null text is an empty document.
    """
    rows = with_front_matter(texts)
    fields = meta_fields(F.col("meta"), F.col("body_raw"), F.col("file_name"))
    rows = rows.select("*", *[c.alias(n) for n, c in fields.items()])
    rows = rows.withColumn("body", clean_body(F.col("body_raw"), F.col("title"), clean))
    rows = rows.withColumn("note", dead_reason(F.col("body"), F.col("status")))
    return rows.withColumn("state", state_of(F.col("note"), F.col("body"), min_chars))


def document_chunks(docs: DataFrame, size: int = 350, overlap: int = 80) -> DataFrame:
    """(doc_id, chunk_id, seq, text, n_chars) of the indexed documents; ids follow from document and place."""
    body = F.when(F.col("state") == "indexed", F.col("body"))
    cut = docs.select("doc_id", F.posexplode(chunk_array(body, size, overlap)).alias("seq", "text"))
    return cut.select("doc_id", F.xxhash64("doc_id", "seq").alias("chunk_id"), "seq", "text", F.length("text").alias("n_chars"))


def estimate(docs: DataFrame, size: int = 350, overlap: int = 80) -> DataFrame:
    """Files, dead, empty, characters, chunks and longest text per source, and in a row with a null source for all."""
    indexed = F.col("state") == "indexed"
    chars = F.length("body")
    rows = docs.withColumn("k", F.size(chunk_array(F.when(indexed, F.col("body")), size, overlap)))
    return rows.rollup("source_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("state") == "dead").alias("dead"), F.count_if(F.col("state") == "empty").alias("empty"),
        F.sum(F.when(indexed, chars).otherwise(0)).alias("chars"), F.sum("k").alias("chunks"), F.max(chars).alias("max_chars"),
    )


def report(docs: DataFrame, short: int = 200) -> DataFrame:
    """What is odd about the parsed ``docs`` (with text) of each source, and the span of their dates.

    Texts with a byte order mark, junk lines and texts that have any, dead ones, those
    without front-matter and those of less than ``short`` characters, all characters, and
    the documents of the latest and the earliest known date.
    """
    junk = junk_counts(F.col("body_raw"), F.col("title"))
    rows = docs.withColumn("__junk", junk.getField("mojibake") + junk.getField("header") + junk.getField("heading"))
    dated = F.when(F.col("date") != "", F.struct("date", "doc_id"))
    return rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.startswith(F.col("text"), F.lit("\ufeff"))).alias("bom"), F.sum("__junk").alias("junk_lines"),
        F.count_if(F.col("__junk") > 0).alias("with_junk"), F.count_if(F.col("state") == "dead").alias("dead"), F.count_if(~F.col("has_meta")).alias("no_front_matter"),
        F.count_if((F.col("state") != "dead") & (F.length("body") < short)).alias("too_short"), F.sum(F.length("body")).alias("chars"),
        F.max(dated).getField("doc_id").alias("newest"), F.min(dated).getField("doc_id").alias("oldest"),
    )
