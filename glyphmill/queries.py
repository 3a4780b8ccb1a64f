"""The queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import catalog, changes, fulltext, incremental, integrity, quotes, vectors
from glyphmill.operators.chunking import chunk_documents
from glyphmill.plans import ingest
from glyphmill.plans.search import search
from glyphmill.runtime import read_table, scratch, stage
from glyphmill.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The query texts of the search queries.
QUERY, SHORT_QUERY, MISSING = "那个记者认为水泥太地下，光水泥就花了", "水泥", "水泥 太"
LONG_QUERY = "那个记者，水泥工厂 harbour warden 建筑师 auction"
_DOC_VALUES = ["source_id", "rel_path", "title", "bvid", "date", "state", "status", "size", "n_chunks", "sha1"]


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """Every core query by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(_SQL)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: the one that was indexed last."""
    rows = read_table(spark, d, "docs").withColumn("at", F.coalesce("indexed_at", F.lit("")))
    one = incremental.latest(rows, ["id"], [F.col("at"), F.col("mtime")], [*_DOC_VALUES, "mtime"])
    return one.withColumnRenamed("id", "doc_id")


_DOCS = (
    "docs_one AS (SELECT * EXCLUDE (k), id AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(indexed_at, '') DESC, mtime DESC NULLS LAST, "
    + ", ".join(f"{c} DESC NULLS LAST" for c in _DOC_VALUES)
    + ") AS k FROM docs) WHERE k = 1)"
)


# Unicode's white space, which DuckDB's \\s and trim do not know
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _sql_stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without repeated rows."""
    return read_table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "doc_id", "seq", "text").distinct()


_CHUNKS = "chunks_one AS (SELECT DISTINCT id AS chunk_id, doc_id, seq, text FROM chunks)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunk_embeddings")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents")
    name = F.concat(F.lit("talk-"), F.coalesce("bvid", F.lit("")), F.lit(".md"))
    rows = rows.select("doc_id", F.col("source").alias("source_id"), F.lit("").alias("rel_path"), name.alias("file_name"), "text")
    return ingest.parse_documents(rows)


@_query(
    r"""WITH s AS (SELECT doc_id, replace(replace(regexp_replace(coalesce(text, ''), '^\x{FEFF}+', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)
    SELECT doc_id, length(t) AS n, len(string_split(t, chr(10))) AS lines, md5(t) AS digest FROM s"""
)
def text_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Byte order marks and line ends."""
    t = T.normalize_newlines(T.strip_bom(F.coalesce("text", F.lit(""))))
    return read_table(spark, d, "documents").select("doc_id", F.length(t).alias("n"), F.size(F.split(t, "\n")).cast("long").alias("lines"), F.md5(t.cast("binary")).alias("digest"))


@_query()
def front_matter_fields(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of both generations of headers."""
    return _parsed(spark, d).select("doc_id", "title", "ext_id", "date", "duration", "vtype", "status")


@_query()
def clean_text_stats(spark: SparkSession, d: str) -> DataFrame:
    """Junk lines by kind and length of the clean body."""
    counts = T.junk_counts(F.col("body_raw"), F.col("title"))
    rows = _parsed(spark, d).select("doc_id", counts.alias("j"), F.length("body").alias("n_chars"), T.junk_scan(F.col("body_raw")).alias("s"))
    return rows.select("doc_id", "n_chars", "j.mojibake", "j.header", "j.heading", "s.private_use", "s.markers")


@_query()
def doc_state_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by state and reason."""
    return _parsed(spark, d).groupBy("state", "note").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""SELECT DISTINCT chunk_id, CASE WHEN length(s) > 60 THEN substr(s, 1, 60) || '…' ELSE s END AS snippet FROM (
    SELECT id AS chunk_id, {_sql_stripped(f"regexp_replace(text, '{_WS}+', ' ', 'g')")} AS s FROM chunks WHERE text IS NOT NULL)""")
def snippets_all(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of all chunks with text."""
    rows = read_table(spark, d, "chunks").where(F.col("text").isNotNull())
    return rows.select(F.col("id").alias("chunk_id"), T.snippet(F.col("text"), 60).alias("snippet")).distinct()


@_query(f"""WITH RECURSIVE base AS (SELECT doc_id, {_sql_stripped("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS t FROM documents WHERE text IS NOT NULL),
    walk AS (
      SELECT doc_id, t, length(t) AS n, 0 AS s, 0 AS k, -1 AS e0 FROM base WHERE length(t) > 350
      UNION ALL
      SELECT doc_id, t, n, CASE WHEN e - 80 > s THEN e - 80 ELSE s + 270 END, k + 1, e FROM (
        SELECT *, CASE WHEN s + 350 < n AND r > 0 THEN a + w - r ELSE least(n, s + 350) END AS e FROM (
          SELECT *, strpos(reverse(substr(t, a + 1, w)), chr(10)) AS r FROM (
            SELECT *, greatest(s + 1, s + 290) AS a, (s + 350) - greatest(s + 1, s + 290) AS w FROM walk WHERE e0 < n))) ),
    spans AS (
      SELECT doc_id, k, {_sql_stripped("substr(t, lag(s) OVER w + 1, e0 - lag(s) OVER w)")} AS piece FROM walk WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    kept AS (SELECT doc_id, k, piece FROM spans WHERE k > 0 AND (length(piece) >= 20 OR k = 1) UNION ALL SELECT doc_id, 1, t FROM base WHERE length(t) <= 350 AND length(t) > 0),
    told AS (SELECT *, lag(piece) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM kept)
    SELECT doc_id, count(*)::BIGINT AS n_chunks, sum(length(piece))::BIGINT AS chars, md5(string_agg(piece, '|' ORDER BY k)) AS digest FROM told WHERE piece IS DISTINCT FROM before GROUP BY doc_id""")
def chunk_documents_all(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document's text, with a digest of their texts in order."""
    body = T.stripped(T.normalize_newlines(F.col("text")))
    cut = chunk_documents(read_table(spark, d, "documents").select("doc_id", body.alias("body")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "|")
    return cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_chars").alias("chars"), F.md5(joined.cast("binary")).alias("digest"))


@_query()
def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole ingest: parse, clean, classify, chunk."""
    return ingest.document_chunks(_parsed(spark, d))


@_query()
def corpus_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Size estimate per source with a grand total."""
    return ingest.estimate(_parsed(spark, d))


@_query()
def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    """What is odd about the documents of each source."""
    return ingest.report(_parsed(spark, d))


@_query(r"""SELECT doc_id, list_slice(list_distinct_ordered, 1, 16) AS terms FROM (
    SELECT doc_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (
      SELECT doc_id, flatten(list_transform(runs, lambda r: CASE
        WHEN regexp_matches(r, '^[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]') AND length(r) > 4 THEN list_transform(range(1, length(r) - 1), lambda i: substr(r, i, 3))
        WHEN regexp_matches(r, '^[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]') OR length(r) >= 3 THEN [r] ELSE [] END)) AS a FROM (
        SELECT id AS doc_id, regexp_extract_all(title, '[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]+|[A-Za-z0-9_]+') AS runs FROM (SELECT DISTINCT id, title FROM docs WHERE title IS NOT NULL))))""")
def title_terms(spark: SparkSession, d: str) -> DataFrame:
    """Search terms of every title."""
    rows = read_table(spark, d, "docs").where(F.col("title").isNotNull()).select(F.col("id").alias("doc_id"), "title").distinct()
    return rows.select("doc_id", fulltext.query_terms_column(F.col("title")).alias("terms"))


def _bm25_sql(query: str) -> str:
    terms = fulltext.searchable(fulltext.query_terms(query))
    # none of these phrases overlaps itself, so occurrences may be counted by removal
    count = lambda t: f"((length(text) - length(replace(lower(text), '{t}', ''))) // {len(t)})"
    tf = ", ".join(f"{count(t)} AS f{i}" for i, t in enumerate(terms))
    any_term = " OR ".join(f"contains(lower(text), '{t}')" for t in terms)
    df = ", ".join(f"count(*) FILTER (contains(lower(text), '{t}')) AS d{i}" for i, t in enumerate(terms))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END"
    parts = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * greatest(length(text) - 2, 0) / mean))" for i in range(len(terms)))
    return f"""{_CHUNKS}, {_DOCS},
    stats AS (SELECT count(*)::DOUBLE AS n, sum(greatest(length(text) - 2, 0))::DOUBLE / count(*) AS mean, {df} FROM chunks_one),
    hits AS (SELECT *, {tf} FROM chunks_one WHERE {any_term}),
    bm25 AS (SELECT chunk_id, doc_id, -({parts}) AS bm25 FROM hits, stats)"""


@_query(f"WITH {_bm25_sql(QUERY)} SELECT chunk_id, round(bm25, 6) + 0.0 AS bm25 FROM bm25 ORDER BY bm25, chunk_id LIMIT 20")
def fts_topk(spark: SparkSession, d: str) -> DataFrame:
    """Best chunks of a phrase query by BM25."""
    best = fulltext.bm25_scan(_chunks(spark, d), QUERY).orderBy("bm25", "chunk_id").limit(20)
    return best.select("chunk_id", F.round("bm25", 6).alias("bm25"))


_INDEXES: dict[tuple[str, str], fulltext.TextIndex] = {}


def text_index(spark: SparkSession, d: str) -> fulltext.TextIndex:
    """The full-text index of the chunks in ``d``, stored once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        chunks = _chunks(spark, d)
        _INDEXES[key] = fulltext.TextIndex.of(stage(fulltext.placed_postings(chunks)), stage(fulltext.indexed_rows(chunks)))
    return _INDEXES[key]


@_query(f"WITH {_bm25_sql(QUERY)} SELECT chunk_id, round(bm25, 4) + 0.0 AS bm25 FROM bm25")
def fts_indexed(spark: SparkSession, d: str) -> DataFrame:
    """All matches by way of the stored index, without a look at the texts."""
    return text_index(spark, d).bm25(QUERY).select("chunk_id", F.round("bm25", 4).alias("bm25"))


@_query(f"WITH {_bm25_sql(LONG_QUERY)} SELECT chunk_id, round(bm25, 4) + 0.0 AS bm25 FROM bm25")
def fts_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The same for phrases of more than three characters, whose trigrams have to follow each other."""
    return text_index(spark, d).bm25(LONG_QUERY).select("chunk_id", F.round("bm25", 4).alias("bm25"))


@_query("""SELECT * FROM (VALUES ('chunks_not_indexed', 0::BIGINT), ('indexed_without_chunk', 0), ('postings_without_chunk', 0), ('indexed_text_differs', 0)) AS t(name, bad)""")
def index_health(spark: SparkSession, d: str) -> DataFrame:
    """The index against the chunks that it was made of: nothing differs."""
    chunks = _chunks(spark, d)
    return integrity.index_health(chunks, stage(fulltext.indexed_rows(chunks)), text_index(spark, d).postings)


@_query(f"WITH {_bm25_sql(QUERY)} SELECT chunk_id, round(bm25, 6) + 0.0 AS bm25 FROM bm25 JOIN docs_one USING (doc_id) WHERE state = 'indexed' AND date >= '2025-06' AND date <= '2026-03' ORDER BY bm25, chunk_id LIMIT 20")
def fts_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same within a span of dates, with the statistics of all chunks."""
    from glyphmill.plans.search import doc_filter

    wanted = doc_filter(_docs(spark, d), date_from="2025-06", date_to="2026-03").select("doc_id")
    best = fulltext.bm25_scan(_chunks(spark, d), QUERY).join(wanted, "doc_id", "left_semi").orderBy("bm25", "chunk_id").limit(20)
    return best.select("chunk_id", F.round("bm25", 6).alias("bm25"))


@_query("SELECT DISTINCT id AS chunk_id FROM chunks WHERE contains(lower(text), '水泥')")
def like_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold a short query itself."""
    return fulltext.like_fallback(_chunks(spark, d), SHORT_QUERY).select("chunk_id").distinct()


@_query(f"""WITH {_bm25_sql(QUERY)},
    ok AS (SELECT b.* FROM bm25 b JOIN docs_one USING (doc_id) WHERE state = 'indexed' ORDER BY bm25, chunk_id LIMIT 200),
    ranked AS (SELECT chunk_id, doc_id, row_number() OVER (ORDER BY bm25, chunk_id) AS r FROM ok),
    capped AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS p FROM ranked)
    SELECT row_number() OVER (ORDER BY r)::INTEGER AS rank, chunk_id, doc_id, r::INTEGER AS fts_rank, round(1.0::DOUBLE / (60 + r), 6) AS score FROM capped WHERE p <= 2 ORDER BY r LIMIT 8""")
def search_fts(spark: SparkSession, d: str) -> DataFrame:
    """The search with the full-text arm alone: cap per document, top k."""
    rows = search(_docs(spark, d), _chunks(spark, d), QUERY, mode="fts").rows
    return rows.select("rank", "chunk_id", "doc_id", "fts_rank", "score")


@_query(_SQL["search_fts"])
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same by way of the stored index."""
    rows = search(_docs(spark, d), _chunks(spark, d), QUERY, mode="fts", index=text_index(spark, d)).rows
    return rows.select("rank", "chunk_id", "doc_id", "fts_rank", "score")


def _probe(spark: SparkSession, d: str) -> list[float]:
    """A query vector: that of the smallest chunk id with a well-formed vector of 128 dimensions."""
    rows = vectors.well_formed(_vectors(spark, d)).where("dim = 128").orderBy("chunk_id", "vec").limit(1)
    found = rows.select("vec").collect()
    return [float(x) for x in found[0]["vec"]] if found else [1.0] * 128


_VECTORS = """ok AS (SELECT DISTINCT chunk_id, model, dim, vec::DOUBLE[] AS v FROM chunk_embeddings WHERE vec IS NOT NULL AND len(vec) = dim
      AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
    probe AS (SELECT v AS q FROM ok WHERE dim = 128 ORDER BY chunk_id, v LIMIT 1),
    most AS (SELECT model, dim FROM chunk_embeddings GROUP BY model, dim ORDER BY count(*) DESC, model, dim LIMIT 1),
    near AS (SELECT chunk_id, max(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))) AS cosine FROM ok JOIN most USING (model, dim), probe WHERE dim = 128 GROUP BY chunk_id)"""


@_query(f"WITH {_VECTORS} SELECT chunk_id, round(cosine, 4) AS cosine FROM near ORDER BY near.cosine DESC, chunk_id LIMIT 20")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of one vector, exactly."""
    return vectors.vector_top(_vectors(spark, d), _probe(spark, d), 20).select("chunk_id", F.round("cosine", 4).alias("cosine"))


_HYBRID = f"""WITH {_bm25_sql(QUERY)}, {_VECTORS},
    a AS (SELECT chunk_id, row_number() OVER (ORDER BY bm25, chunk_id) AS r FROM (SELECT b.chunk_id, bm25 FROM bm25 b JOIN docs_one USING (doc_id) WHERE state = 'indexed' ORDER BY bm25, chunk_id LIMIT 200)),
    b AS (SELECT chunk_id, row_number() OVER (ORDER BY cosine DESC, chunk_id) AS r FROM (SELECT n.chunk_id, cosine FROM near n JOIN chunks_one USING (chunk_id) JOIN docs_one USING (doc_id) WHERE state = 'indexed' ORDER BY cosine DESC, chunk_id LIMIT 200)),
    f AS (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.r AS fts_rank, b.r AS vector_rank, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS score FROM a FULL JOIN b USING (chunk_id)
      ORDER BY score DESC, chunk_id LIMIT 200),
    g AS (SELECT f.*, c.doc_id, date FROM f JOIN chunks_one c USING (chunk_id) JOIN docs_one d USING (doc_id))"""


@_query(f"""{_HYBRID}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) AS p FROM g)
    SELECT chunk_id, doc_id, fts_rank::INTEGER AS fts_rank, vector_rank::INTEGER AS vector_rank, round(score, 6) AS score FROM m WHERE p <= 2 ORDER BY m.score DESC, chunk_id LIMIT 8""")
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Both arms, fused by reciprocal rank, capped per document."""
    result = search(_docs(spark, d), _chunks(spark, d), QUERY, _vectors(spark, d), query_vector=_probe(spark, d))
    return result.rows.select("chunk_id", "doc_id", "fts_rank", "vector_rank", "score")


@_query(_SQL["search_hybrid"])
def search_indexed_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The same by way of the stored index."""
    result = search(_docs(spark, d), _chunks(spark, d), QUERY, _vectors(spark, d), query_vector=_probe(spark, d), index=text_index(spark, d))
    return result.rows.select("chunk_id", "doc_id", "fts_rank", "vector_rank", "score")


@_query(f"""{_HYBRID}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY date DESC, score DESC, chunk_id) AS p FROM g),
    t AS (SELECT row_number() OVER (ORDER BY date DESC, m.score DESC, chunk_id)::INTEGER AS rank, chunk_id, date, round(score, 6) AS score FROM m WHERE p <= 2)
    SELECT * FROM t WHERE rank <= 8""")
def search_recent(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid search, newest first."""
    result = search(_docs(spark, d), _chunks(spark, d), QUERY, _vectors(spark, d), query_vector=_probe(spark, d), sort="recent", index=text_index(spark, d))
    return result.rows.select("rank", "chunk_id", "date", "score")


@_query("SELECT model, dim, count(*) AS n FROM chunk_embeddings GROUP BY model, dim")
def model_groups(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by model and dimension (A3)."""
    return vectors.model_groups(_vectors(spark, d))


@_query("SELECT model, dim FROM chunk_embeddings GROUP BY model, dim ORDER BY count(*) DESC, model, dim LIMIT 1")
def dominant_model(spark: SparkSession, d: str) -> DataFrame:
    """The model of most vectors (A4, V4)."""
    return vectors.dominant_model(_vectors(spark, d)).select("model", "dim")


_NORMS = """f AS (SELECT sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS n FROM chunk_embeddings WHERE vec IS NOT NULL ORDER BY chunk_id, model LIMIT 400)"""


@_query(f"WITH {_NORMS} SELECT count(*) AS checked, count(*) FILTER (isnan(n) OR abs(n - 1) > 1e-3) AS off FROM f")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """How many of the first vectors are not of unit length."""
    return vectors.norm_check(_vectors(spark, d))


@_query(f"""WITH {_DOCS} SELECT count(*) AS docs, count(*) FILTER (state = 'indexed') AS indexed, count(*) FILTER (state = 'dead') AS dead, count(*) FILTER (state = 'empty') AS "empty",
    (SELECT count(*) FROM (SELECT DISTINCT id, doc_id, seq, text FROM chunks)) AS chunks, (SELECT count(*) FROM chunk_embeddings) AS vectors FROM docs_one""")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by state, chunks and vectors."""
    return catalog.corpus_counts(_docs(spark, d), _chunks(spark, d), _vectors(spark, d))


@_query("SELECT state, count(*) AS n FROM docs GROUP BY state")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows by state (A2)."""
    return catalog.state_counts(read_table(spark, d, "docs"))


@_query(f"WITH {_DOCS} SELECT source_id, count(*) AS files, max(mtime) AS newest, min(mtime) AS oldest, sum(size)::BIGINT AS bytes, count(*) FILTER (state = 'dead') AS dead FROM docs_one GROUP BY source_id")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files per source with newest and oldest."""
    return catalog.source_summary(_docs(spark, d))


@_query(f"WITH {_DOCS} SELECT doc_id, title, date FROM docs_one WHERE state = 'indexed' AND date >= '2025-03-01' ORDER BY date DESC, doc_id DESC LIMIT 50 OFFSET 20")
def list_documents_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the catalogue."""
    return catalog.list_documents(_docs(spark, d), date_from="2025-03-01", offset=20).select("doc_id", "title", "date")


@_query(f"WITH {_DOCS} SELECT doc_id, title FROM docs_one WHERE contains(lower(title), '海关')")
def list_title_contains(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a part of the title."""
    return catalog.filtered_documents(_docs(spark, d), title_contains="海关", include_dead=True).select("doc_id", "title")


@_query(f"WITH {_DOCS} SELECT count(*) AS total FROM docs_one WHERE state = 'indexed' AND source_id = (SELECT min(source_id) FROM docs)")
def list_total(spark: SparkSession, d: str) -> DataFrame:
    """Total of a listing of one source."""
    source = read_table(spark, d, "docs").agg(F.min("source_id")).first()[0]
    return catalog.filtered_documents(_docs(spark, d), source=source).agg(F.count(F.lit(1)).alias("total"))


@_query(f"WITH {_DOCS} SELECT bvid, doc_id, date FROM (SELECT *, row_number() OVER (PARTITION BY bvid ORDER BY date DESC NULLS LAST, doc_id DESC) AS p FROM docs_one WHERE bvid <> '') WHERE p = 1")
def latest_per_id(spark: SparkSession, d: str) -> DataFrame:
    """The document of the latest date of every external id."""
    return incremental.latest(_docs(spark, d).where(F.col("bvid") != ""), ["bvid"], [F.col("date"), F.col("doc_id")], ["doc_id", "date"])


@_query("""SELECT doc_id, length(t) AS total_chars, 100 AS "offset", length(substr(t, 101, 500)) AS returned_chars, 100 + length(substr(t, 101, 500)) < length(t) AS has_more, substr(t, 101, 500) AS text
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def fetch_window(spark: SparkSession, d: str) -> DataFrame:
    """A window of every document."""
    rows = read_table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    return catalog.fetch_window(rows, 100, 500)


@_query(f"""WITH {_DOCS}, b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE length(text) > 2000)),
    a AS (SELECT doc_id, t, strpos(t, substr(t, 1001, 60)) - 1 AS p FROM b)
    SELECT doc_id, length(t) AS total_chars, greatest(p - 100, 0)::INTEGER AS "offset", length(substr(t, greatest(p - 100, 0) + 1, 300)) AS returned_chars,
      greatest(p - 100, 0) + length(substr(t, greatest(p - 100, 0) + 1, 300)) < length(t) AS has_more, substr(t, greatest(p - 100, 0) + 1, 300) AS text FROM a""")
def fetch_by_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The window around a chunk that begins at the 1001st character of a document."""
    docs = read_table(spark, d, "documents").select("doc_id", F.lit("").alias("rel_path"), F.col("text").alias("body"))
    first = docs.where(F.length("body") > 2000).agg(F.min("doc_id").alias("doc_id"))
    chunk = docs.join(F.broadcast(first), "doc_id").select(F.lit(1).cast("long").alias("chunk_id"), "doc_id", F.substring("body", 1001, 350).alias("text"))
    return catalog.fetch(docs, chunk, chunk_id=1, max_chars=300)


@_query("SELECT DISTINCT id AS chunk_id FROM chunks WHERE id NOT IN (SELECT chunk_id FROM chunk_embeddings WHERE chunk_id IS NOT NULL)")
def chunks_without_vector(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that lack a vector."""
    return integrity.chunks_without_vector(_chunks(spark, d), _vectors(spark, d))


@_query("SELECT DISTINCT chunk_id FROM chunk_embeddings WHERE chunk_id NOT IN (SELECT id FROM chunks)")
def vectors_without_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose chunk is gone."""
    return integrity.vectors_without_chunk(_chunks(spark, d), _vectors(spark, d))


@_query("SELECT model, dim, count(*) AS n FROM chunk_embeddings WHERE vec IS NULL OR len(vec) <> dim GROUP BY model, dim")
def wrong_dims(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose length is not dim."""
    return integrity.wrong_dims(_vectors(spark, d))


@_query(f"""WITH {_DOCS}, c AS (SELECT doc_id, count(DISTINCT id) AS found FROM chunks GROUP BY doc_id)
    SELECT d.doc_id, n_chunks, coalesce(found, 0) AS found FROM docs_one d LEFT JOIN c USING (doc_id) WHERE state = 'indexed' AND n_chunks IS DISTINCT FROM coalesce(found, 0)""")
def chunk_count_errors(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a stale number of chunks."""
    return integrity.chunk_count_errors(_docs(spark, d), _chunks(spark, d))


@_query("SELECT DISTINCT id AS chunk_id, n_chars, length(text) AS length FROM chunks WHERE n_chars IS DISTINCT FROM length(text)")
def length_errors(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a wrong stored length."""
    return integrity.length_errors(read_table(spark, d, "chunks").withColumnRenamed("id", "chunk_id"))


@_query(f"""WITH {_DOCS}, {_NORMS}, c AS (SELECT doc_id, count(DISTINCT id) AS found FROM chunks GROUP BY doc_id)
    SELECT 'chunks_without_vector' AS name, count(DISTINCT id) AS bad FROM chunks WHERE id NOT IN (SELECT chunk_id FROM chunk_embeddings WHERE chunk_id IS NOT NULL)
    UNION ALL SELECT 'vectors_without_chunk', count(DISTINCT chunk_id) FROM chunk_embeddings WHERE chunk_id NOT IN (SELECT id FROM chunks)
    UNION ALL SELECT 'chunk_count', count(*) FROM docs_one LEFT JOIN c USING (doc_id) WHERE state = 'indexed' AND n_chunks IS DISTINCT FROM coalesce(found, 0)
    UNION ALL SELECT 'text_length', count(*) FROM (SELECT DISTINCT id, n_chars, length(text) FROM chunks WHERE n_chars IS DISTINCT FROM length(text))
    UNION ALL SELECT 'wrong_dims', count(*) FROM chunk_embeddings WHERE vec IS NULL OR len(vec) <> dim
    UNION ALL SELECT 'further_models', greatest(count(DISTINCT (model, dim)) - 1, 0) FROM chunk_embeddings
    UNION ALL SELECT 'norms', count(*) FILTER (isnan(n) OR abs(n - 1) > 1e-3) FROM f""")
def health(spark: SparkSession, d: str) -> DataFrame:
    """All checks of the tables with the number of offending rows (I3-I5, I7-I9); those of the index are in index_health."""
    chunks = read_table(spark, d, "chunks").withColumnRenamed("id", "chunk_id")
    return integrity.health(_docs(spark, d), chunks, _vectors(spark, d))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return incremental.latest(read_table(spark, d, "file_state"), ["source_id", "rel_path"], [F.col("seen_at")], ["sha1", "size", "mtime"])


def _finished(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "docs").where(F.col("indexed_at") != "")
    return incremental.latest(rows, ["source_id", "rel_path"], [F.col("indexed_at")], ["sha1", "size", "mtime"])


_SEEN = "seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, rel_path ORDER BY seen_at DESC NULLS LAST, sha1 DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS k FROM file_state) WHERE k = 1)"
_FINISHED = "done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, rel_path ORDER BY indexed_at DESC, sha1 DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS k FROM docs WHERE indexed_at <> '') WHERE k = 1)"


@_query(f"""WITH {_SEEN}, {_FINISHED} SELECT * FROM (SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.rel_path, b.rel_path) AS rel_path,
    CASE WHEN b.rel_path IS NULL THEN 'new' WHEN a.rel_path IS NULL THEN 'removed' WHEN abs(a.mtime - b.mtime) > 1.0 OR a.size IS DISTINCT FROM b.size THEN 'changed' END AS change
    FROM seen a FULL JOIN done b ON a.source_id = b.source_id AND a.rel_path = b.rel_path) WHERE change IS NOT NULL""")
def scan_changes(spark: SparkSession, d: str) -> DataFrame:
    """New, changed and removed files."""
    return changes.scan_changes(_seen(spark, d), _finished(spark, d))


@_query(f"WITH {_SEEN}, {_FINISHED} SELECT a.source_id, a.rel_path FROM seen a JOIN done b USING (source_id, rel_path) WHERE (a.mtime IS DISTINCT FROM b.mtime OR a.size IS DISTINCT FROM b.size) AND a.sha1 = b.sha1")
def touched_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose stamp changed but not their content."""
    return changes.touched(_seen(spark, d), _finished(spark, d))


@_query("""WITH seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, rel_path ORDER BY seen_at DESC NULLS LAST, sha1 DESC NULLS LAST) AS k FROM file_state) WHERE k = 1),
    done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, rel_path ORDER BY replace(indexed_at, ' ', 'T') DESC, sha1 DESC NULLS LAST) AS k FROM docs WHERE length(trim(indexed_at)) > 0) WHERE k = 1)
    SELECT s.source_id, s.rel_path FROM seen s WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.source_id = s.source_id AND d.rel_path = s.rel_path AND d.sha1 IS NOT DISTINCT FROM s.sha1)""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that a new run has to process, each once (problem 7)."""
    return incremental.files_to_process(read_table(spark, d, "docs"), read_table(spark, d, "file_state"))


@_query(f"WITH {_SEEN} SELECT source_id, rel_path, sha1, size, mtime FROM seen")
def p7_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last sighting of every file as a table that two runs keep: what was seen up to the middle of the time, then all (problem 7)."""
    keys, values = ["source_id", "rel_path"], ["sha1", "size", "mtime"]
    rows = read_table(spark, d, "file_state")
    span = rows.agg(F.min("seen_at").alias("a"), F.max("seen_at").alias("b"), F.count(F.lit(1)).alias("n")).first()
    table = incremental.IncrementalTable(spark, scratch(spark, "latest"), keys, [*values, "seen_at"], incremental.buckets_for(span["n"]))
    last = lambda some: incremental.latest(some, ["bucket", *keys], [F.col("seen_at")], values)
    if span["a"] is not None:
        table.run(rows.where(F.col("seen_at") <= span["a"] + (span["b"] - span["a"]) / 2), last)
    table.run(rows, last)
    return table.read().select(*keys, *values) if table.exists() else rows.select(*keys, *values).where("false")


_NOW = "2026-09-01 00:00:00"


@_query(f"""WITH t AS (SELECT id, pid, coalesce(try_cast(nullif(updated_at, '') AS TIMESTAMP), try_cast(nullif(started_at, '') AS TIMESTAMP)) AS heard FROM jobs WHERE status = 'running'),
    s AS (SELECT *, date_diff('second', heard, TIMESTAMP '{_NOW}') / 60.0 AS m FROM t)
    SELECT id, CASE WHEN coalesce(pid, 0) > 0 AND pid % 2 = 1 THEN 'process gone' WHEN coalesce(pid, 0) > 0 AND (m IS NULL OR m >= 15) THEN 'silent' WHEN coalesce(pid, 0) <= 0 AND (m IS NULL OR m >= 30) THEN 'lost' END AS reason
    FROM s WHERE reason IS NOT NULL""")
def reaped_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Running jobs that are dead, where even pids are alive (M8, M9)."""
    jobs = read_table(spark, d, "jobs")
    alive = jobs.where((F.col("pid") > 0) & (F.col("pid") % 2 == 0)).select("pid").distinct()
    return changes.reap_jobs(jobs, F.to_timestamp(F.lit(_NOW)), alive)


@_query("SELECT count(*) AS n FROM index_log WHERE replace(ts, ' ', 'T') >= '2025-06-01T00:00:00'")
def log_retention(spark: SparkSession, d: str) -> DataFrame:
    """Log rows that retention keeps."""
    return changes.retained(read_table(spark, d, "index_log"), "2025-06-01T00:00:00").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT source_id, action, count(*) AS n, coalesce(sum(ms), 0)::BIGINT AS ms FROM (SELECT DISTINCT id, source_id, action, ms FROM index_log) GROUP BY source_id, action")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """What index runs did, per source and action."""
    return changes.run_summary(read_table(spark, d, "index_log"))


@_query("""SELECT id, last_value(note IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_note
    FROM (SELECT DISTINCT id, source_id, nullif(note, '') AS note FROM index_log)""")
def last_note(spark: SparkSession, d: str) -> DataFrame:
    """The last note of the source at each log row."""
    rows = read_table(spark, d, "index_log").select("id", "source_id", F.nullif(F.col("note"), F.lit("")).alias("note")).distinct()
    return changes.last_known(rows, ["source_id"], ["id"], "note", "last_note").select("id", "last_note")


@_query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per week and type (tumbling windows)."""
    return streams.event_counts(read_table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
    g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users (session windows)."""
    rows = streams.sessions(read_table(spark, d, "events"), "user_id", "12 hours")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "bench_items").select(F.col("item_id").alias("quote_id"), F.substring("text", 20, 40).alias("quote"))
    return rows.withColumn("declared", F.lit(None).cast("long"))


@_query("SELECT DISTINCT i.item_id, d.doc_id FROM bench_items i JOIN documents d ON contains(d.text, substr(i.text, 20, 40))")
def quote_exact_locate(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a quotation literally (Q-6, J13): one pass, quotes on the small side."""
    found = quotes.literal_hits(_quotes(spark, d), read_table(spark, d, "documents"))
    return found.select(F.col("quote_id").alias("item_id"), "doc_id")


@_query()
def quote_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on a passage of every evaluation item (Q-1 - Q-17)."""
    docs = _parsed(spark, d).select("doc_id", "body", "body_raw")
    return quotes.verify_quotes(_quotes(spark, d), docs)


@_query()
def quote_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the verdicts."""
    return quotes.summary(quote_verdicts(spark, d))


@_query()
def article_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotations of block-quote lines with the id before them (Q-18)."""
    rows = read_table(spark, d, "documents").where(F.col("text").isNotNull())
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("> "), x))
    return quotes.extract_quotes(rows.select(F.col("doc_id").alias("article_id"), F.array_join(lines, "\n").alias("text")))


@_query(f"""WITH {_VECTORS}, c AS (SELECT a.chunk_id, a.v AS x, b.v AS y FROM ok a JOIN ok b ON a.chunk_id = b.chunk_id AND a.dim = 128 AND b.dim = 96)
    SELECT count(*) AS both_models FROM (SELECT DISTINCT chunk_id FROM c)""")
def models_in_common(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a usable vector in both models; how far the models agree is in model_agreement."""
    rows = vectors.well_formed(_vectors(spark, d))
    two = rows.where("dim IN (96, 128)").groupBy("chunk_id").agg(F.countDistinct("dim").alias("k")).where("k = 2")
    return two.agg(F.count(F.lit(1)).alias("both_models"))


@_query()
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of neighbours and cosines of every two models over all common chunks."""
    return vectors.model_agreement(_vectors(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid search over the tables in ``d``."""
    return search(_docs(spark, d), _chunks(spark, d), QUERY, _vectors(spark, d), query_vector=_probe(spark, d)).rows


