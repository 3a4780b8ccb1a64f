"""Full-text search: trigram phrases scored with BM25, by scan or by a postings table."""

from __future__ import annotations

import math
import re

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Constants of the score and the tokens of a query.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
CJK = "㐀-鿿豈-﫿"
CONTENT = "[0-9A-Za-z㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]"


def has_content(query: str | None) -> bool:
    """Whether a query holds a letter, digit, ideograph, kana or hangul at all."""
    return bool(query and re.search(CONTENT, query))


def query_terms(query: str, max_terms: int = 16) -> list[str]:
    """Phrases of a query: ideographic runs (beyond four as trigrams) and words of three letters or more."""
    terms: list[str] = []
    for run in re.findall(f"[{CJK}]+|[A-Za-z0-9_]+", query):
        if re.match(f"[{CJK}]", run):
            terms += [run] if len(run) <= 4 else [run[i : i + 3] for i in range(len(run) - 2)]
        elif len(run) >= 3:
            terms.append(run)
    return list(dict.fromkeys(terms))[:max_terms]


def query_terms_column(query: Column, max_terms: int = 16) -> Column:
    """:func:`query_terms` as an array column."""
    runs = F.regexp_extract_all(query, F.lit(f"([{CJK}]+|[A-Za-z0-9_]+)"), 1)
    wide = lambda r: r.rlike(f"^[{CJK}]")
    grams = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: r.substr(i, F.lit(3)))
    empty = F.array().cast("array<string>")
    split = F.transform(runs, lambda r: F.when(wide(r) & (F.length(r) > 4), grams(F.when(wide(r) & (F.length(r) > 4), r).otherwise("   "))).when(wide(r) | (F.length(r) >= 3), F.array(r)).otherwise(empty))
    return F.slice(F.array_distinct(F.flatten(split)), 1, max_terms)


def _overlaps_itself(term: str) -> bool:
    return any(term[:k] == term[-k:] for k in range(1, len(term)))


def term_frequency(text: Column, term: str) -> Column:
    """Occurrences of ``term`` in ``text``, overlapping ones included; both lower-case."""
    if _overlaps_itself(term):
        return F.regexp_count(text, F.lit(f"(?=\\Q{term}\\E)"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def searchable(terms: list[str]) -> list[str]:
    """Lower-case phrases that a trigram index can match: three characters or more."""
    return [t.lower() for t in terms if len(t) >= 3]


def bm25_scan(chunks: DataFrame, query: str, max_terms: int = 16, id_col: str = "chunk_id") -> DataFrame:
    """``chunks`` that hold a phrase of ``query``, with ``bm25`` (more negative is better).

    One aggregate pass gives the number of chunks, their mean length and the document
    frequency of each phrase over the whole table; the scoring pass first drops chunks
    without any phrase. Statistics are those of all chunks, whatever is filtered later.
    A query without phrases of three characters gives no rows.
    """
    terms = searchable(query_terms(query, max_terms))
    if not terms:
        return chunks.withColumn("bm25", F.lit(0.0)).where("false")
    low = F.col("__low")
    stats = chunks.select(F.lower("text").alias("__low")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.length(low) - 2, F.lit(0))).alias("size"),
        *[F.count_if(F.contains(low, F.lit(t))).alias(f"d{i}") for i, t in enumerate(terms)],
    ).first()
    return _scored(chunks, terms, stats["n"], stats["size"] or 0, [stats[f"d{i}"] for i in range(len(terms))])


def _scored(chunks: DataFrame, terms: list[str], n: int, size: int, df: list[int]) -> DataFrame:
    mean = size / n if n and size else 1.0
    # one pattern finds the candidates in one pass; the text is lower-cased once for all frequencies
    found = chunks.where(F.lower("text").rlike("|".join(f"\\Q{t}\\E" for t in terms))).withColumn("__low", F.lower("text"))
    low = F.col("__low")
    norm = K1 * (F.lit(1 - B) + B * F.greatest(F.length("text") - 2, F.lit(0)) / F.lit(float(mean)))
    score = F.lit(0.0)
    for t, d in zip(terms, df, strict=True):
        idf = math.log((n - d + 0.5) / (d + 0.5))
        tf = term_frequency(low, t)
        score = score + F.lit(float(idf if idf > 0 else LEAST_IDF)) * (tf * (K1 + 1) / (tf + norm))
    return found.withColumn("bm25", -score).drop("__low")


def like_fallback(chunks: DataFrame, query: str) -> DataFrame:
    """``chunks`` that hold the stripped query itself, without regard to case, with a score of 0."""
    q = query.strip()
    rows = chunks.withColumn("bm25", F.lit(0.0))
    return rows.where(F.contains(F.lower("text"), F.lit(q.lower()))) if len(q) >= 2 else rows.where("false")


def postings(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(trigram, chunk_id, tf): the inverted index of all chunks, to be written once and reused."""
    # the lower-case text is bound once, outside the loop over places
    low = F.array(F.lower("text"))
    grams = F.flatten(F.transform(low, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: t.substr(i, F.lit(3)))))
    rows = chunks.where(F.length("text") >= 3).select(F.col(id_col).alias("chunk_id"), F.explode(grams).alias("trigram"))
    return rows.groupBy("trigram", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row (n, size): number of chunks and sum of their lengths in trigrams."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.greatest(F.length("text") - 2, F.lit(0))), F.lit(0)).alias("size"))


def bm25_indexed(chunks: DataFrame, index: DataFrame, stats: DataFrame, query: str, max_terms: int = 16, id_col: str = "chunk_id") -> DataFrame:
    """As :func:`bm25_scan`, but only chunks that the index names for all trigrams of a phrase are read.

    The query's trigrams (a few dozen) are the join's small side; longer phrases are
    then checked in the text itself.
    """
    terms = searchable(query_terms(query, max_terms))
    if not terms:
        return chunks.withColumn("bm25", F.lit(0.0)).where("false")
    need = sorted({(i, t[k : k + 3]) for i, t in enumerate(terms) for k in range(len(t) - 2)})
    wanted = chunks.sparkSession.createDataFrame(need, "term int, trigram string")
    sizes = {i: len({g for j, g in need if j == i}) for i in range(len(terms))}
    lengths = chunks.sparkSession.createDataFrame(sorted(sizes.items()), "term int, grams int")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("have"))
    full = met.join(F.broadcast(lengths), "term").where(F.col("have") == F.col("grams"))
    named = full.select("chunk_id").distinct()
    some = chunks.join(named, chunks[id_col] == named["chunk_id"], "left_semi")
    low = some.select(F.lower("text").alias("__low"))
    df = low.agg(*[F.count_if(F.contains("__low", F.lit(t))).alias(f"d{i}") for i, t in enumerate(terms)]).first()
    total = stats.first()
    return _scored(some, terms, total["n"], total["size"], [df[f"d{i}"] for i in range(len(terms))])


#: A trigram as one number: three code points of 21 bits each.
_BITS = 21


def gram_code(gram: str) -> int:
    """The number of a trigram."""
    a, b, c = map(ord, gram)
    return a << 2 * _BITS | b << _BITS | c


def placed_postings(chunks: DataFrame) -> DataFrame:
    """(gram, chunk_id, doc_id, n, places): the full-text index of ``chunks`` (chunk_id, doc_id, text), sorted by trigram.

    ``n`` is the chunk's length in trigrams, ``places`` where the trigram stands in the
    lower-case text, so phrases of any length are found and scored without the text. Rows
    are made chunk by chunk in Arrow batches; only they are shuffled, by ranges of trigram
    and chunk, so that a frequent trigram is written by several tasks. Null texts and
    texts shorter than a trigram have no row.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column("low").to_pylist()
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
                first = np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(len(texts)), sizes - 2)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - 2) - (sizes - 2), sizes - 2)
                start = first[owner] + place
                gram = points[start] << 2 * _BITS | points[start + 1] << _BITS | points[start + 2]
                order = np.lexsort((place, gram, owner))
                gram, owner, place = gram[order], owner[order], place[order]
                edge = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])
                own = pa.array(owner[edge])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[edge]), batch.column("chunk_id").take(own), batch.column("doc_id").take(own), pa.array((sizes[owner[edge]] - 2).astype(np.int32)),
                        pa.ListArray.from_arrays(np.r_[edge, len(gram)].astype(np.int32), pa.array(place.astype(np.int32))),
                    ],
                    ["gram", "chunk_id", "doc_id", "n", "places"],
                )

    some = chunks.select("chunk_id", "doc_id", F.lower("text").alias("low")).where(F.length("low") >= 3)
    found = some.mapInArrow(rows, "gram long, chunk_id long, doc_id long, n int, places array<int>")
    return found.repartitionByRange("gram", "chunk_id").sortWithinPartitions("gram", "chunk_id")


def indexed_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, n, h): what the index holds of each chunk: its document, its length in trigrams and a hash of its text."""
    return chunks.select("chunk_id", "doc_id", F.greatest(F.length("text") - 2, F.lit(0)).cast("long").alias("n"), F.xxhash64("text").alias("h"))


class TextIndex:
    """A stored full-text index: postings, the documents of the chunks, and the number and total length of all chunks."""

    def __init__(self, postings: DataFrame, owners: DataFrame, rows: int, size: int) -> None:
        self.postings, self.owners, self.rows, self.size = postings, owners, rows, size

    @classmethod
    def of(cls, postings: DataFrame, indexed: DataFrame) -> TextIndex:
        """The index of stored ``postings`` and ``indexed`` rows, whose totals are read once."""
        total = indexed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")).first()
        return cls(postings, indexed.select("chunk_id", "doc_id"), total["n"], total["size"])

    def bm25(self, query: str, max_terms: int = 16) -> DataFrame:
        """(chunk_id, doc_id, bm25) of all chunks with a phrase of ``query``, scored as :func:`bm25_scan` does, without the texts.

        The query's trigrams, a few dozen, are the join's small side and a filter that
        reaches the sorted files. Only the counts per phrase come to the driver.
        """
        spark = self.postings.sparkSession
        terms = searchable(query_terms(query, max_terms))
        if not terms:
            return spark.createDataFrame([], "chunk_id long, doc_id long, bm25 double")
        need = [(gram_code(t[k : k + 3]), i, k) for i, t in enumerate(terms) for k in range(len(t) - 2)]
        wanted = spark.createDataFrame(need, "gram long, term int, shift int")
        lengths = F.element_at(F.array(*[F.lit(len(t) - 2) for t in terms]), F.col("term") + 1)
        some = self.postings.where(F.col("gram").isin(sorted({g for g, _, _ in need}))).join(F.broadcast(wanted), "gram")
        one = some.where(lengths == 1).select("term", "chunk_id", "doc_id", "n", F.size("places").cast("long").alias("tf"))
        starts = some.where(lengths > 1).select("term", "chunk_id", "doc_id", "n", F.explode(F.transform("places", lambda p: p - F.col("shift"))).alias("at"))
        whole = starts.groupBy("term", "chunk_id", "doc_id", "n", "at").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == lengths)
        found = one if all(len(t) == 3 for t in terms) else one.union(whole.groupBy("term", "chunk_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("tf")))
        counts = {r["term"]: r["d"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("d")).collect()}
        mean = self.size / self.rows if self.rows and self.size else 1.0
        idf = [math.log((self.rows - counts.get(i, 0) + 0.5) / (counts.get(i, 0) + 0.5)) for i in range(len(terms))]
        weight = F.element_at(F.array(*[F.lit(x if x > 0 else LEAST_IDF) for x in idf]), F.col("term") + 1)
        norm = K1 * (F.lit(1 - B) + B * F.col("n") / F.lit(float(mean)))
        part = weight * (F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
        # added in the order of the phrases, so that equal chunks have equal scores
        parts = F.array_sort(F.collect_list(F.struct("term", part.alias("s"))))
        scored = found.groupBy("chunk_id", "doc_id").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"]).alias("s"))
        return scored.select("chunk_id", "doc_id", (-F.col("s")).alias("bm25"))
