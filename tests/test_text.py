"""Cleaning, front-matter, classification, chunks and search terms on small fixtures."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import fulltext
from glyphmill.operators.chunking import chunk_documents, chunk_spans
from glyphmill.plans.ingest import parse_documents


def parsed(spark, *texts):
    rows = [(i, "s", "p", "talk-X1.md", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, source_id string, rel_path string, file_name string, text string")
    return {r["doc_id"]: r for r in parse_documents(df).collect()}


def test_front_matter(spark):
    body = "一" * 40
    out = parsed(
        spark,
        f"﻿---\r\nTitle: \"甲\"\r\ntitle: '乙'\r\ndescription: 丙 (2025-01-02)\r\n---\r\n{body}",
        f"---\ntitle: 甲\n{body}",
        f" ---\ntitle: 甲\n ---\n---\n{body}",
        f"# 标题 #\n{body}",
        None,
        "",
    )
    assert out[0]["title"] == "乙" and out[0]["date"] == "2025-01-02" and out[0]["body"] == body
    assert out[1]["has_meta"] is False and out[1]["body_raw"].startswith("---")
    assert out[2]["has_meta"] is True and out[2]["body"] == body
    assert out[3]["title"] == "标题" and out[3]["body"] == body
    assert out[4]["state"] == "dead" and out[4]["note"] == "empty_body" and out[5]["state"] == "dead"
    assert out[0]["ext_id"] == "X1"


def test_dead_and_empty(spark):
    out = parsed(spark, "短", '{"error": 1}', "Bad Gateway", "x" * 1500 + "Bad Gateway", "<html>" + "y" * 50, "<html>" + "y" * 5000, "---\nstatus: Dead\n---\n" + "z" * 50)
    assert [out[i]["state"] for i in range(7)] == ["empty", "dead", "dead", "indexed", "dead", "indexed", "dead"]
    assert [out[i]["note"] for i in (1, 2, 4, 6)] == ["json_error_body", "api_error_body", "html_error_body", "status_marked_dead"]


def test_junk_lines(spark):
    df = spark.createDataFrame([("ab\n锛x\n@{page=1}. date)\nBVID: bvid\n# T\n\n\n\n好  \n ",)], "b string")
    row = df.select(T.clean_body(F.col("b"), F.lit("T")).alias("c"), T.junk_counts(F.col("b"), F.lit("T")).alias("j"), T.junk_scan(F.col("b")).alias("s")).first()
    assert row["c"] == "好" and tuple(row["j"]) == (2, 2, 1) and tuple(row["s"]) == (1, 1)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="甲乙\n 。x", max_size=1500))
def test_chunks_cover_the_text(text):
    out = chunk_spans(text, 100, 20, 0)
    assert all(len(c) <= 100 for c in out)
    assert {c for c in text if not c.isspace()} == {c for piece in out for c in piece if not c.isspace()}


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "短"), (5, "字" * 1000)], "doc_id long, body string")
    rows = chunk_documents(docs).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["seq"]) for r in rows][:2] == [(4, 0), (5, 0)]
    assert max(r["n_chars"] for r in rows) == 350


def test_terms(spark):
    cases = ["水泥", "光水泥就花了", "ab abc ABC abc", "，。", "naïve x_1", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, q string")
    got = {r["i"]: r["t"] for r in df.select("i", fulltext.query_terms_column(F.col("q")).alias("t")).collect()}
    assert all(got[i] == fulltext.query_terms(c) for i, c in enumerate(cases) if c is not None) and got[5] is None


def test_bm25_by_scan_and_index(spark):
    rows = [(1, "aaaaaa 文字"), (2, "AAA"), (3, "其他文字"), (4, "ab"), (5, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    scan = {r["chunk_id"]: r["bm25"] for r in fulltext.bm25_scan(chunks, "aaa").collect()}
    index = fulltext.bm25_indexed(chunks, fulltext.postings(chunks), fulltext.corpus_stats(chunks), "aaa")
    assert scan.keys() == {1, 2} and {r["chunk_id"]: round(r["bm25"], 9) for r in index.collect()} == {k: round(v, 9) for k, v in scan.items()}
    assert fulltext.bm25_scan(chunks, "文字").count() == 0 and fulltext.like_fallback(chunks, "文字").count() == 2
    assert fulltext.bm25_scan(chunks.where("false"), "aaa").count() == 0
