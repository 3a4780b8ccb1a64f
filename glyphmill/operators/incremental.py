"""Problem 7 and change detection: processing only what is new or changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.runtime import scratch, stage

#: Rows that a bucket should hold, and the least and the largest number of buckets.
BUCKET_ROWS, FEWEST, MOST = 8192, 16, 16_384
#: Columns of a stored table: whether a line is a derived row or the mark of its bucket, and the mark's fingerprint.
LIVE, ROWS, HASH = "__live", "__rows", "__hash"


def buckets_for(rows: int) -> int:
    """Buckets that a table of so many rows is compared in."""
    return max(FEWEST, min(MOST, rows // BUCKET_ROWS))


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Bucket of a key by hash; null keys have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def fingerprints(df: DataFrame, keys: list[str], values: list[str], buckets: int) -> DataFrame:
    """(bucket, n, h): count and sum of row hashes of each bucket.

    Both are additive, so partial sums are made before the shuffle and the order of
    rows does not matter; a repeated row changes the count. Two hashes of a row are
    summed as decimals, which do not overflow.
    """
    row = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in [*keys, *values]]
    first, second = F.xxhash64(*row), F.xxhash64(F.lit(1), *row)
    return df.select(bucket_of(keys, buckets).alias("bucket"), first.alias("a"), second.alias("b")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.concat_ws("/", F.sum(F.col("a").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)"))).alias("h"),
    )


def changed_buckets(now: DataFrame, before: DataFrame) -> DataFrame:
    """(bucket, n): buckets whose fingerprint differs, new and vanished (n = 0) ones included."""
    a, b = now.alias("a"), before.alias("b")
    both = a.join(b, "bucket", "full_outer")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.h").eqNullSafe(F.col("b.h"))
    return both.where(~same).select("bucket", F.coalesce("a.n", F.lit(0)).alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The row with the largest ``order`` of each key: keys and values; ties go to the largest values.

    An aggregate with partial maxima, so a key with many rows costs one row per task.
    """
    top = F.max(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *values)).alias("__m")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__m.{v}").alias(v) for v in values])


class IncrementalTable:
    """A derived table of which each run recomputes only the buckets whose input changed.

    ``path`` holds the derived rows, partitioned by bucket, and in each partition one line
    more, the bucket's mark: the fingerprint of the input that it was made from. A run
    writes the changed buckets, rows and marks together, with dynamic partition overwrite,
    which replaces each bucket as a whole; a bucket without derived rows keeps a mark
    alone, so that no old row stays. Where a run breaks off, a bucket has its old rows and
    mark or its new ones, and the next run makes those again whose mark is old: nothing is
    skipped, and nothing is there twice. Rows that come while a run goes on are not in the
    fingerprints it began with, so the next run sees their buckets as changed.

    Keys and values may be null; a repeated row changes its bucket. The number of buckets
    must stay the same for one ``path``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str], buckets: int = 256) -> None:
        self.spark, self.path, self.keys, self.values, self.buckets = spark, path, keys, values, buckets

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self) -> bool:
        """Whether a first run has finished."""
        files, where = self._at("_begun")
        return files.exists(where)

    def prints(self) -> DataFrame:
        """(bucket, n, h): the input that each bucket was made from."""
        if not self.exists():
            return self.spark.createDataFrame([], "bucket int, n long, h string")
        return self.spark.read.parquet(self.path).where(~F.col(LIVE)).select("bucket", F.col(ROWS).alias("n"), F.col(HASH).alias("h"))

    def read(self) -> DataFrame:
        """The derived rows, with their bucket; FileNotFoundError before the first run with any row."""
        if not self.exists():
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(self.path).where(LIVE).drop(LIVE, ROWS, HASH)

    def run(self, rows: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> int:
        """Bring the table up to date with ``rows``; returns the number of buckets made again.

        ``derive`` gets the rows of the changed buckets with their column ``bucket`` and
        must keep it. The list of changed buckets, which is broadcast, is bounded by their
        number; a crowded bucket is written by several tasks.
        """
        now = stage(fingerprints(rows, self.keys, self.values, self.buckets))
        changed = stage(changed_buckets(now, self.prints()).select("bucket"))
        count = changed.count()
        if not count:
            return 0
        some = rows.withColumn("bucket", bucket_of(self.keys, self.buckets)).join(F.broadcast(changed), "bucket", "left_semi")
        marks = changed.join(now, "bucket", "left").select(
            "bucket", F.lit(False).alias(LIVE), F.coalesce("n", F.lit(0)).alias(ROWS), F.coalesce("h", F.lit("")).alias(HASH)
        )
        first = not self.exists()
        if first:
            files, where = self._at("")
            files.delete(where, True)  # what a first run that broke off has left
        lines = derive(some).withColumn(LIVE, F.lit(True)).unionByName(marks, allowMissingColumns=True).hint("rebalance", "bucket")
        lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        if first:
            files, where = self._at("_begun")
            files.create(where, True).close()
        return count


def files_to_process(docs: DataFrame, file_state: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """(source_id, rel_path) of the files that a new run has to process, each once.

    On disk a file is its row of ``file_state`` with the largest seen_at; finished it is
    by its row of ``docs`` with the largest indexed_at that is neither null nor ''. A
    file is due if it has no finished row or another sha1 there (null differs from a
    value, two nulls are equal); mtime and size alone are no change, files only in docs
    are not due. The due files are an :class:`IncrementalTable` at ``path`` (a scratch
    table where it is not given): it is brought up to date with what has finished, of
    which nothing is due, and then with what lies on disk, which recomputes and replaces
    the buckets of the two that differ. The answer depends on what has finished, so a run
    that broke off and starts again gets exactly what is left. Empty tables are allowed.
    """
    keys = ["source_id", "rel_path"]
    seen = stage(latest(file_state.select(*keys, "sha1", "seen_at"), keys, [F.col("seen_at")], ["sha1"]))
    ended = docs.select(*keys, "sha1", F.translate("indexed_at", " ", "T").alias("at")).where(F.length(F.trim("indexed_at")) > 0)
    done = stage(latest(ended, keys, [F.col("at")], ["sha1"]))
    spark = docs.sparkSession
    table = IncrementalTable(spark, path or scratch(spark, "due"), keys, ["sha1"], buckets or buckets_for(seen.count() + done.count()))

    def due(rows: DataFrame) -> DataFrame:
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in [*keys, "sha1"]]
        return rows.alias("s").join(done.alias("d"), same, "left_anti").select("bucket", *keys)

    table.run(done, due)
    table.run(seen, due)
    return table.read().select(*keys) if table.exists() else seen.select(*keys).where("false")
