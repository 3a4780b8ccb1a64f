"""Problem 2: one ranking from several differently scaled scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.numbering import HOT, value_ranks
from glyphmill.runtime import cut

#: Scores of search_scores and whether higher is better.
SEARCH_ARMS = {"bm25": False, "cosine": True, "like_hits": True, "age_days": False}


def fuse_ranks(
    rows: DataFrame,
    keys: list[str],
    item: str,
    arms: dict[str, bool],
    k: int = 60,
    top: int | None = None,
    hot: int = HOT,
) -> DataFrame:
    """Reciprocal rank fusion: (keys, item, fused, rank), best first.

    Each arm ranks the items that it scored; an item gets the sum of 1/(k+rank).
    A null or NaN score means that the arm did not return the item. One missing
    arm of three or more gets the mean of the item's other terms, so that it
    neither helps nor harms; every further one gets nothing. Infinite scores rank
    as the extremes that they are. Equal scores share the better rank; equal sums
    are ordered by item. Rows repeated for an item count once, with the best score
    of each arm; an item without any score is left out. An empty table gives an
    empty result; further columns are not read.

    ``item`` is numeric. ``top`` keeps the best of each key: Spark then cuts to
    ``top`` rows per task before the last shuffle. Without it, keys of more than
    ``hot`` items are ranked in buckets, as the arms are.
    """
    score = {a: F.when(~F.isnan(F.col(a).cast("double")), F.col(a).cast("double")) for a in arms}
    best = [(F.max if higher else F.min)(score[a]).alias(a) for a, higher in arms.items()]
    once = rows.groupBy(*keys, F.col(item).alias("__item")).agg(*best)
    # one row per item and arm, with a score where lower is better
    each = F.array(*[
        F.struct(F.lit(i).alias("arm"), (F.col(a) * F.lit(-1.0 if higher else 1.0)).alias("v"))
        for i, (a, higher) in enumerate(arms.items())
    ])
    long = once.select(*keys, "__item", F.explode(each).alias("__s"))
    long = long.select(*keys, "__item", F.col("__s.arm").alias("__arm"), F.col("__s.v").alias("__score"))
    long = cut(long.where(F.col("__score").isNotNull()))
    ranked = value_ranks(long, [*keys, "__arm"], "__score", "__rank", hot)
    sums = ranked.groupBy(*keys, F.col("__item").alias(item)).agg(
        F.array_sort(F.collect_list(1.0 / (k + F.col("__rank")))).alias("__t")  # at most one term per arm
    )
    total = F.aggregate("__t", F.lit(0.0), lambda a, x: a + x)
    there = F.size("__t")
    spare = F.when((there < len(arms)) & F.lit(len(arms) >= 3), total / there).otherwise(0.0)
    fused = sums.select(*keys, item, F.round(total + spare, 12).alias("fused"))
    if top is not None:
        first = Window.partitionBy(*keys).orderBy(F.desc("fused"), F.asc_nulls_last(item))
        return fused.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    fused = cut(fused.withColumn("__worse", -F.col("fused")))
    placed = value_ranks(fused, keys, "__worse", "__above", hot)
    placed = value_ranks(placed, [*keys, "__worse"], item, "__tie", hot)
    return placed.select(*keys, item, "fused", (F.col("__above") + F.col("__tie") - 1).cast("int").alias("rank"))
