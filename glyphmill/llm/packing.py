"""Problem 8: filling training sequences of a fixed capacity with documents."""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.numbering import BUCKET, bucket_offsets
from glyphmill.runtime import stage

#: Vocabulary file whose tokens are counted; a name of the folder of public tokenizers, or a path.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Documents of one length that one task numbers, about, and the least number of buckets.
RANK_ROWS, RANK_BUCKETS = 500_000, 64


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file lies: ``name`` itself if it is a path."""
    return name if "/" in name else importlib.import_module("public_tokenizers").path(name)


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str | None], name: str = TOKENIZER) -> list[int]:
    """Tokens of each text; 0 for null and ''."""
    encoding = _encoding(tokenizer_path(name), importlib.import_module("public_tokenizers").PATTERN)
    return [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]


def with_tokens(documents: DataFrame, name: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) of every document; whole texts are tokenized, a repeated row comes once."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = token_counts(batch.column(1).to_pylist(), name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, tokens bigint").distinct()


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, in the order placed) and how often each is used.

    Lengths are placed longest first. An item closes a pack that it fills exactly if
    there is one; else it goes into the shortest (emptiest) pack that takes it, as the
    items to come are smaller and fill what is left; else a pack is opened. Counts of equal
    patterns are handled together, so the time depends on the lengths and patterns,
    not on the items.
    """
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        left = histogram.get(length, 0)
        while left:
            fit = length if room.get(length) else max((r for r, p in room.items() if r >= length and p), default=0)
            if not fit:
                # as many new packs as items: later, smaller lengths fill them
                group = room.setdefault(capacity - length, {})
                group[(length,)] = group.get((length,), 0) + left
                break
            pattern, n = next(iter(room[fit].items()))
            used = min(n, left)
            if used == n:
                del room[fit][pattern]
            else:
                room[fit][pattern] = n - used
            group = room.setdefault(fit - length, {})
            new = (*pattern, length)
            group[new] = group.get(new, 0) + used
            left -= used
    return [(p, n) for r in sorted(room) for p, n in sorted(room[r].items())]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, place): which ranks of a length go to which sequences.

    Sequences of one pattern are numbered in a row; the k-th sequence takes the k-th
    rank of the range of each of its places.
    """
    out, taken, sequence = [], {}, 0
    for pattern, n in patterns:
        for place, length in enumerate(pattern):
            first = taken.get(length, 0)
            out.append((length, first, first + n - 1, sequence, place))
            taken[length] = first + n
        sequence += n
    return out


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(doc_id, part, sequence, place, tokens): a sequence for every document.

    Shortest-pack-first over the histogram of lengths, which has at most ``capacity``
    entries and is all that comes to the driver. A document over the capacity becomes
    full parts of its own sequences and a rest that is packed like a document; no other
    is divided. Patterns are joined back by the rank of a document within its length,
    counted in buckets by a hash, so that no length is numbered by one task. Documents
    without tokens are given place -1 in sequence -1. Null sizes count as 0; an empty
    table gives an empty result; a repeated id is packed once per row.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = sizes.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("n"))
    full = F.floor(F.col("n") / capacity)
    rest = F.col("n") % capacity
    rows = rows.select("doc_id", "n", full.alias("full"), rest.alias("rest"))
    spark = sizes.sparkSession
    items = stage(rows)
    counts = items.where(F.col("rest") > 0).groupBy("rest").agg(F.count(F.lit(1)).alias("k"))
    histogram = {r["rest"]: r["k"] for r in counts.collect()}
    most = items.agg(F.sum(F.signum("full")).alias("k")).first()["k"] or 0
    buckets = max(RANK_BUCKETS, int(max([most, *histogram.values()]) // RANK_ROWS))
    items = items.withColumn(BUCKET, F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    table = slots(shortest_pack_first(histogram, capacity))
    after = max((s + b - a + 1 for _, a, b, s, _ in table), default=0)
    per_bucket = items.where(F.col("rest") > 0).groupBy("rest", BUCKET).agg(F.count(F.lit(1)).alias("k"))
    offsets = bucket_offsets(per_bucket, ["rest"], "k").drop("k")
    order = Window.partitionBy("rest", BUCKET).orderBy("doc_id")
    ranked = items.where(F.col("rest") > 0).withColumn("r", F.row_number().over(order) - 1)
    ranked = ranked.join(offsets, ["rest", BUCKET]).withColumn("rank", F.col("r") + F.col("__offset"))
    # the ranges of all lengths, in the order of length and first rank; as many as the patterns have places
    ranges = np.array(sorted(table), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((ranges[:, 0] << 40 | ranges[:, 1], ranges))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranges = shared.value
        for batch in batches:
            rest, rank = np.asarray(batch.column("rest")), np.asarray(batch.column("rank"))
            own = ranges[np.searchsorted(keys, rest << 40 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4].astype(np.int32)), batch.column("rest")],
                ["doc_id", "part", "sequence", "place", "tokens"],
            )

    tails = ranked.select("doc_id", F.col("full").cast("int").alias("part"), "rest", F.col("rank").cast("long").alias("rank"))
    tails = tails.mapInArrow(place, "doc_id bigint, part int, sequence bigint, place int, tokens bigint")
    big = items.where(F.col("full") > 0)
    sums = big.groupBy(BUCKET).agg(F.sum("full").alias("k")).withColumn("__one", F.lit(0))
    base = bucket_offsets(sums, ["__one"], "k").select(BUCKET, "__offset")
    before = Window.partitionBy(BUCKET).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    heads = big.withColumn("r", F.coalesce(F.sum("full").over(before), F.lit(0))).join(base, BUCKET)
    heads = heads.select("doc_id", (F.col("r") + F.col("__offset")).alias("at"), F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("p"))
    heads = heads.select(
        "doc_id", F.col("p").cast("int").alias("part"), (F.lit(after) + F.col("at") + F.col("p")).alias("sequence"), F.lit(0).alias("place"), F.lit(capacity).cast("long").alias("tokens")
    )
    none = items.where(F.col("n") == 0).select("doc_id", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("sequence"), F.lit(-1).alias("place"), F.lit(0).cast("long").alias("tokens"))
    return tails.union(heads).union(none)
