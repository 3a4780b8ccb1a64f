"""Listing against index state, jobs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan_changes(seen: DataFrame, indexed: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(source_id, rel_path, change): new, changed or removed files; equal ones are left out.

    A file is changed if its time differs by more than ``tolerance`` seconds or its size
    differs. Both sides have one row per file.
    """
    a, b = seen.alias("a"), indexed.alias("b")
    on = F.col("a.source_id").eqNullSafe(F.col("b.source_id")) & F.col("a.rel_path").eqNullSafe(F.col("b.rel_path"))
    both = a.withColumn("here", F.lit(1)).alias("a").join(b.withColumn("there", F.lit(1)).alias("b"), on, "full_outer")
    moved = (F.abs(F.col("a.mtime") - F.col("b.mtime")) > tolerance) | ~F.col("a.size").eqNullSafe(F.col("b.size"))
    change = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").when(moved, "changed")
    rows = both.select(F.coalesce("a.source_id", "b.source_id").alias("source_id"), F.coalesce("a.rel_path", "b.rel_path").alias("rel_path"), change.alias("change"))
    return rows.where(F.col("change").isNotNull())


def touched(seen: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose time or size changed but whose content did not: only their stamp is to be renewed."""
    on = ["source_id", "rel_path"]
    other = seen.alias("a").join(indexed.alias("b"), on)
    moved = ~F.col("a.mtime").eqNullSafe(F.col("b.mtime")) | ~F.col("a.size").eqNullSafe(F.col("b.size"))
    return other.where(moved & (F.col("a.sha1") == F.col("b.sha1"))).select(*on)


def reap_jobs(jobs: DataFrame, now: Column, alive: DataFrame, silent_min: int = 15, lost_min: int = 30) -> DataFrame:
    """(id, reason) of running jobs that are dead.

    Those with a pid are dead if the pid is not in ``alive`` (pid) or nothing was heard
    for ``silent_min`` minutes; those without, after ``lost_min`` minutes. An unreadable
    time counts as silence; the start stands for a missing last sign of life.
    """
    heard = F.coalesce(F.try_to_timestamp(F.nullif(F.col("updated_at"), F.lit(""))), F.try_to_timestamp(F.nullif(F.col("started_at"), F.lit(""))))
    silence = (F.unix_timestamp(now) - F.unix_timestamp(heard)) / 60
    running = jobs.where(F.col("status") == "running").withColumn("__s", silence)
    known = running.join(alive.select("pid", F.lit(True).alias("__alive")).distinct(), "pid", "left")
    has_pid = F.coalesce(F.col("pid"), F.lit(0)) > 0
    reason = (
        F.when(has_pid & F.col("__alive").isNull(), "process gone")
        .when(has_pid & (F.col("__s").isNull() | (F.col("__s") >= silent_min)), "silent")
        .when(~has_pid & (F.col("__s").isNull() | (F.col("__s") >= lost_min)), "lost")
    )
    return known.select("id", reason.alias("reason")).where(F.col("reason").isNotNull())


def retained(log: DataFrame, cutoff: str) -> DataFrame:
    """Log rows from ``cutoff`` on, by the text of their time."""
    return log.where(F.translate("ts", " ", "T") >= cutoff)


def last_known(rows: DataFrame, part: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """``rows`` with the last non-null ``column`` at or before each row (as-of within ``part``)."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(column, ignorenulls=True).over(w))


def run_summary(log: DataFrame) -> DataFrame:
    """(source_id, action, n, ms): what index runs did; repeated rows count once."""
    once = log.dropDuplicates(["id"])
    return once.groupBy("source_id", "action").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"))
