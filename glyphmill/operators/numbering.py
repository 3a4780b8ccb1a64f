"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.runtime import cut

BUCKET = "__bucket"


def bucket_offsets(counts: DataFrame, keys: list[str], size: str, out: str = "__offset") -> DataFrame:
    """Rows before each bucket of its key: ``counts`` has one row per (keys, bucket).

    The window sorts buckets, not rows, so a key that holds a large part of the
    table costs one row per bucket here.
    """
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)))


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """1-based position of each row among the rows of its ``keys``.

    ``bucket`` must grow with ``order`` (rows of a lower bucket come first) and
    bound the rows of one (keys, bucket) group; each such group is sorted in a
    task of its own and the counts of the buckets before it are added. Null
    keys form a group. An empty input gives an empty result.
    """
    rows = df.withColumn(BUCKET, bucket)
    counts = rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    offsets = bucket_offsets(counts, keys, "__n").drop("__n")
    ranked = rows.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order)))
    on = [ranked[k].eqNullSafe(offsets[k]) for k in [*keys, BUCKET]]
    joined = ranked.join(offsets, on, "inner")
    return joined.select(*[ranked[c] for c in df.columns], (ranked["__pos"] + offsets["__offset"]).alias(out))


#: Distinct values from which one group is ranked in several buckets, and their number.
HOT, CUTS = 200_000, 255


def value_ranks(df: DataFrame, group: list[str], value: str, out: str, hot: int = HOT) -> DataFrame:
    """``df`` with the rank of ``value`` (numeric, ascending) within ``group``; ties share the lower rank.

    Equal values are counted first (map-side), so ties cost one row. Groups of
    more than ``hot`` different values are ranked in up to 256 buckets cut at
    their quantiles, each in a task of its own; the quantiles are written before
    use, so that a repeated task sees the same ones. Null and NaN values get a
    null rank, null keys form a group.
    """
    v = F.col(value).cast("double")
    real = df.where(F.col(value).isNotNull() & ~F.isnan(v))
    counts = real.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    points = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    large = counts.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(
        F.count(F.lit(1)).alias("__c"), F.percentile_approx(v, points, 2000).alias("__cuts")
    )
    large = cut(large.where(F.col("__c") > hot).drop("__c"))
    if large.isEmpty():
        placed = counts.withColumn(BUCKET, F.lit(0))
    else:
        same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
        below = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < v))
        placed = counts.join(large, same, "left").select(*counts.columns, below.alias(BUCKET))
    before = Window.partitionBy(*group, BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1)
    if not large.isEmpty():
        sizes = placed.groupBy(*group, BUCKET).agg(F.sum("__n").alias("__n"))
        offsets = bucket_offsets(sizes, group, "__n").select(
            *[F.col(g).alias(f"__{g}") for g in group], F.col(BUCKET).alias("__b"), "__offset"
        )
        same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
        ranked = ranked.join(offsets, [*same, F.col(BUCKET) == F.col("__b")])
        ranked = ranked.withColumn("__r", F.col("__r") + F.col("__offset"))
    ranks = ranked.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(value).alias("__v"), F.col("__r").alias(out))
    on = [*[F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col(value) == F.col("__v")]
    return df.join(ranks, on, "left").select(*df.columns, out)
