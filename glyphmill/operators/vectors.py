"""Vector arm: exact cosine over stored vectors, checks of vectors, pluggable embedders."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.runtime import stage


class Embedder(Protocol):
    """What turns texts into unit vectors."""

    available: bool
    reason: str
    model_id: str

    def encode(self, texts: list[str], prefix: str = "") -> np.ndarray:
        """Unit rows, one per text."""


class HashingEmbedder:
    """Deterministic stand-in where no model is at hand: signed counts of character trigrams. It knows no meaning."""

    available, reason = True, ""

    def __init__(self, dim: int = 128) -> None:
        self.dim, self.model_id = dim, f"hashing::trigram::{dim}"

    def encode(self, texts: list[str], prefix: str = "") -> np.ndarray:
        """Unit rows; texts shorter than a trigram are one gram."""
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            s = prefix + text
            for k in range(max(1, len(s) - 2)):
                h = int.from_bytes(hashlib.blake2b(s[k : k + 3].encode("utf-8", "replace"), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(chunks: DataFrame, embedder: Embedder, prefix: str = "", id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, model, dim, vec) of all chunks, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.encode([t or "" for t in texts], prefix)))

    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.lit(embedder.model_id).alias("model"), encode("text").alias("vec"))
    return rows.select("chunk_id", "model", F.size("vec").alias("dim"), "vec")


def norm(vec: Column) -> Column:
    """Euclidean length, summed in double in element order."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(vec: Column, query: list[float]) -> Column:
    """Inner product with a fixed vector, summed in double in element order."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vec, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def well_formed(vectors: DataFrame) -> DataFrame:
    """Rows whose vec has dim elements, no NaN, and is not all zero."""
    v = F.col("vec")
    return vectors.where(v.isNotNull() & (F.size(v) == F.col("dim")) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0))


def model_groups(vectors: DataFrame) -> DataFrame:
    """(model, dim, n) by falling count."""
    return vectors.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model", "dim")


def dominant_model(vectors: DataFrame) -> DataFrame:
    """The (model, dim) of most rows; ties go to the first by name."""
    return model_groups(vectors).limit(1)


def vector_top(vectors: DataFrame, query: list[float], limit: int = 200, id_col: str = "chunk_id", every: DataFrame | None = None) -> DataFrame:
    """(chunk_id, cosine): the ``limit`` nearest rows of the model that most vectors (of ``every``, if given) are of; ties by id.

    No row where that model has another dimension than the query. The model is one row,
    so it is the small side of the join. Top rows are kept per task before they meet
    (TakeOrderedAndProject).
    """
    length = float(np.sqrt(sum(float(x) * float(x) for x in query)))
    model = dominant_model(vectors if every is None else every).where(F.col("dim") == len(query)).select("model", "dim")
    rows = well_formed(vectors).join(F.broadcast(model), ["model", "dim"])
    scored = rows.select(F.col(id_col).alias("chunk_id"), (dot(F.col("vec"), query) / (norm(F.col("vec")) * length)).alias("cosine"))
    return scored.groupBy("chunk_id").agg(F.max("cosine").alias("cosine")).orderBy(F.desc("cosine"), "chunk_id").limit(limit)


def norm_check(vectors: DataFrame, sample: int = 400, tolerance: float = 1e-3) -> DataFrame:
    """(checked, off): the first ``sample`` vectors by chunk id and how many of them are not of unit length."""
    first = vectors.where(F.col("vec").isNotNull()).orderBy("chunk_id", "model").limit(sample)
    return first.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.isnan(norm(F.col("vec"))) | (F.abs(norm(F.col("vec")) - 1) > tolerance)).alias("off"))


#: Chunks of a block in which the neighbours of model_agreement are looked for.
AGREEMENT_BLOCK = 8192


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block_neighbours(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """(chunk_id, side, near): the ``k`` nearest rows of ``right`` of each row of ``left``, without itself, by either vector."""
    ids, others = np.array(left["chunk_id"]), np.array(right["chunk_id"])
    out: list[tuple[int, int, list[dict]]] = []
    if len(ids) and len(others):
        for side, name in enumerate(("x", "y")):
            q, base = _unit_rows(left[name]), _unit_rows(right[name])
            for at in range(0, len(ids), 1024):
                # equal vectors are ties, whatever the order of summing
                score = np.round(q[at : at + 1024] @ base.T, 9)
                own = ids[at : at + 1024]
                score[own[:, None] == others] = -np.inf
                least = -np.sort(np.partition(-score, min(k, len(others)) - 1, axis=1)[:, :k], axis=1)[:, -1]
                for i, row in enumerate(score):
                    top = np.flatnonzero((row >= least[i]) & (row > -np.inf))
                    top = top[np.lexsort((others[top], -row[top]))][:k]
                    out.append((int(own[i]), side, [{"far": -float(row[j]), "id": int(others[j])} for j in top]))
    kinds = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())]))
    return pa.table({"chunk_id": pa.array([r[0] for r in out], pa.int64()), "side": pa.array([r[1] for r in out], pa.int32()), "near": pa.array([r[2] for r in out], kinds)})


def model_agreement(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Agreement of every two models over all chunks that both have a usable vector of.

    Of each chunk the ``k`` nearest other ones are found by each model, exactly and among
    the common chunks: top1_agreement is the share of chunks with the same nearest one,
    top5_overlap the mean share of common neighbours. The cosines are those of the two
    vectors of a chunk, null where the dims differ. Blocks of chunks are compared with
    blocks, so the work grows with the square of the common chunks, memory does not. Of
    repeated vectors of a chunk the least counts.
    """
    rows = well_formed(vectors).where(F.col("chunk_id").isNotNull() & (norm(F.col("vec")) < float("inf")))
    rows = rows.groupBy(F.col("chunk_id").cast("long").alias("chunk_id"), "model", "dim").agg(F.min("vec").alias("vec"))
    kinds = sorted(tuple(r) for r in vectors.select("model", "dim").where("model IS NOT NULL AND dim IS NOT NULL").distinct().collect())
    results = []
    for (model_a, dim_a), (model_b, dim_b) in combinations(kinds, 2):
        one = lambda m, n, name: rows.where((F.col("model") == m) & (F.col("dim") == n)).select("chunk_id", F.col("vec").alias(name))
        both = stage(one(model_a, dim_a, "x").join(one(model_b, dim_b, "y"), "chunk_id"))
        blocks = max(1, -(-both.count() // AGREEMENT_BLOCK))
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        own = both.withColumn("own", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
        left = own.select(F.col("own").alias("a"), every.alias("b"), "chunk_id", "x", "y").groupBy("a", "b")
        right = own.select(every.alias("a"), F.col("own").alias("b"), "chunk_id", "x", "y").groupBy("a", "b")
        look = lambda p, q: _block_neighbours(p, q, k)
        near = left.cogroup(right).applyInArrow(look, "chunk_id long, side int, near array<struct<far:double,id:bigint>>")
        near = near.groupBy("chunk_id", "side").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        ids = lambda side: F.first(F.when(F.col("side") == side, F.col("near.id")), ignorenulls=True)
        pair = near.groupBy("chunk_id").agg(ids(0).alias("p"), ids(1).alias("q")).where(F.size("p") > 0)
        shares = pair.agg(
            F.avg((F.get("p", F.lit(0)) == F.get("q", F.lit(0))).cast("double")).alias("top1_agreement"),
            F.avg(F.size(F.array_intersect("p", "q")) / F.size("p")).alias("top5_overlap"),
        )
        product = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
        cosine = product / (norm(F.col("x")) * norm(F.col("y"))) if dim_a == dim_b else F.lit(None).cast("double")
        cosines = both.select(cosine.alias("c")).agg(
            F.count(F.lit(1)).alias("common"), F.avg("c").alias("mean_cosine"), F.min("c").alias("min_cosine"), F.percentile("c", F.lit(0.01)).alias("p1_cosine")
        )
        names = [F.lit(v).alias(n) for v, n in ((model_a, "model_a"), (dim_a, "dim_a"), (model_b, "model_b"), (dim_b, "dim_b"))]
        results.append(cosines.crossJoin(shares).select(*names, "common", "top1_agreement", "top5_overlap", "mean_cosine", "min_cosine", "p1_cosine"))
    if not results:
        schema = "model_a string, dim_a int, model_b string, dim_b int, common long, top1_agreement double, top5_overlap double, mean_cosine double, min_cosine double, p1_cosine double"
        return vectors.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, results)
