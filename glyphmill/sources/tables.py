"""Stored tables on Parquet: create, upsert, delete, append, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the largest by its other columns, so the same on each run."""
    values = [c for c in rows.columns if c not in keys]
    if not values:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*values)).alias("__m")).select(*[F.col(c) if c in keys else F.col("__m")[c].alias(c) for c in rows.columns])


#: Folders of one table from which an append writes the whole table anew.
MOST_PARTS = 64


class Store:
    """A folder of Parquet tables. A table is a list of folders in its pointer file.

    A write makes a new folder and then points to it, an append adds one to the list, so
    only new rows are written; a run that breaks off leaves the list as it was. Folders
    that are in neither the list nor the one before it are removed by the next write, so
    that a reader of the list before can finish.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _parts(self, name: str, pointer: str = "current") -> list[str]:
        fs, where = self._fs(f"{self.root}/{name}/{pointer}")
        return [r[0] for r in self.spark.read.text(str(where)).collect()] if fs.exists(where) else []

    def _point(self, name: str, parts: list[str]) -> None:
        before = self._parts(name)
        for pointer, lines in (("before", before), ("current", parts)):
            fs, where = self._fs(f"{self.root}/{name}/{pointer}")
            out = fs.create(where, True)
            out.write(bytearray("\n".join(lines).encode()))
            out.close()
        fs, where = self._fs(f"{self.root}/{name}")
        for status in fs.listStatus(where):
            if status.isDirectory() and status.getPath().getName() not in {*before, *parts}:
                fs.delete(status.getPath(), True)

    def exists(self, name: str) -> bool:
        """Whether the table was ever written."""
        return bool(self._parts(name))

    def read(self, name: str) -> DataFrame:
        """The table as it is now."""
        parts = self._parts(name)
        if not parts:
            raise FileNotFoundError(f"no table {name!r} in {self.root}")
        return self.spark.read.parquet(*[f"{self.root}/{name}/{p}" for p in parts])

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace the table."""
        part = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{part}")
        self._point(name, [part])

    def upsert(self, name: str, rows: DataFrame, keys: list[str], keep: list[str] | None = None) -> None:
        """Rows replace those of equal keys (of several with one key the largest counts), but for the columns ``keep``, which stay as they were; others are added."""
        if not self.exists(name):
            return self.write(name, _one_each(rows, keys))
        old = self.read(name)
        new = _one_each(rows, keys)
        if keep:
            had = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
            new = new.join(had, keys, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in keep})
            new = new.drop(*[f"__{c}" for c in keep])
        rest = old.join(new.select(*keys), keys, "left_anti")
        self.write(name, rest.unionByName(new.select(*rows.columns), allowMissingColumns=True))

    def update(self, name: str, changes: DataFrame, keys: list[str]) -> None:
        """Non-null values of ``changes`` replace those of equal keys; nothing is added."""
        old = self.read(name)
        values = [c for c in changes.columns if c not in keys]
        new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
        both = old.join(new, keys, "left")
        self.write(name, both.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns]))

    def delete(self, name: str, keys: DataFrame) -> None:
        """Remove the rows whose key is in ``keys`` (its columns are the key)."""
        self.write(name, self.read(name).join(keys.distinct(), keys.columns, "left_anti"))

    def delete_documents(self, ids: DataFrame, docs: str | None = "docs") -> None:
        """Remove documents (doc_id) with their chunks, index rows and vectors, the dependent tables first; ``docs`` None leaves the documents."""
        ids = ids.select("doc_id").distinct()
        gone = self.read("chunks").join(ids, "doc_id", "left_semi").select("chunk_id").distinct() if self.exists("chunks") else None
        for name in ("embeddings", "indexed"):
            if gone is not None and self.exists(name):
                self.delete(name, gone)
        for name in ("postings", "chunks", docs):
            if name and self.exists(name):
                self.delete(name, ids)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; those already there are not written again, unless the columns differ or the table has many parts."""
        parts = self._parts(name)
        if not parts:
            return self.write(name, rows)
        have = self.read(name)
        if len(parts) >= MOST_PARTS or {(f.name, f.dataType) for f in have.schema} != {(f.name, f.dataType) for f in rows.schema}:
            return self.write(name, have.unionByName(rows, allowMissingColumns=True))
        part = f"v-{uuid.uuid4().hex}"
        rows.select(*have.columns).write.parquet(f"{self.root}/{name}/{part}")
        self._point(name, [*parts, part])

    def retain(self, name: str, column: str, cutoff: str) -> None:
        """Keep the rows whose time, as text, is ``cutoff`` or later."""
        self.write(name, self.read(name).where(F.col(column) >= cutoff))
