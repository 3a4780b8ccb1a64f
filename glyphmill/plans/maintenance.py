"""Keeping the stored tables current: index runs, freshness, jobs, backfill of vectors."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.config import Settings
from glyphmill.operators.changes import scan_changes
from glyphmill.operators.fulltext import TextIndex, indexed_rows, placed_postings
from glyphmill.operators.integrity import backfill, index_health
from glyphmill.operators.vectors import Embedder, dominant_model, embed
from glyphmill.plans.ingest import document_chunks, parse_documents
from glyphmill.plans.search import Result, search
from glyphmill.runtime import stage
from glyphmill.sources.files import decoded, digest, folder_version, list_files
from glyphmill.sources.tables import Store

JOB_SCHEMA = "id string, kind string, status string, started_at string, finished_at string, total long, done long, message string, pid long, updated_at string"
LOG_SCHEMA = "ts string, source_id string, rel_path string, action string, result string, note string, ms long"
DOC_COLUMNS = [
    "doc_id", "source_id", "rel_path", "file_name", "title", "ext_id", "date", "duration", "vtype", "status", "size", "mtime", "sha1", "state",
    "note", "n_chunks", "indexed_at", "body", "body_raw",
]


def now() -> str:
    """The time as ISO text, to the second, in UTC."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S")


class Jobs:
    """The table of jobs."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def start(self, kind: str, total: int = 0, pid: int = 0) -> str:
        """A new running job; returns its id."""
        job = uuid.uuid4().hex[:12]
        row = (job, kind, "running", now(), None, total, 0, "", pid, now())
        self.store.append("jobs", self.store.spark.createDataFrame([row], JOB_SCHEMA))
        return job

    def update(self, job: str, **values: Any) -> None:
        """Set fields of a job and its last sign of life."""
        values["updated_at"] = now()
        columns = {c.split()[0]: c for c in JOB_SCHEMA.split(", ")}
        schema = ", ".join(["id string", *[columns[k] for k in values]])
        self.store.update("jobs", self.store.spark.createDataFrame([(job, *values.values())], schema), ["id"])

    def finish(self, job: str, status: str = "done", message: str = "") -> None:
        """End a job."""
        self.update(job, status=status, message=message, finished_at=now())

    def get(self, job: str) -> dict | None:
        """A job by its id."""
        row = self.store.read("jobs").where(F.col("id") == job).first() if self.store.exists("jobs") else None
        return row.asDict() if row else None

    def recent(self, n: int = 5) -> DataFrame:
        """The jobs that started last."""
        return self.store.read("jobs").orderBy(F.desc("started_at"), "id").limit(n)

    def busy(self) -> bool:
        """Whether a job runs."""
        return self.store.exists("jobs") and not self.store.read("jobs").where("status = 'running'").isEmpty()


@dataclass
class Run:
    """What an index run did."""

    source_id: str
    counts: dict[str, int] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    locked: bool = False


class Index:
    """The stored tables of all sources and what keeps them current."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings, embedder: Embedder | None = None) -> None:
        self.spark, self.settings, self.embedder = spark, settings, embedder
        self.store = Store(spark, root)
        self.jobs = Jobs(self.store)
        self._checked = 0.0

    def _listing(self, source: dict, content: bool) -> DataFrame:
        rows = list_files(self.spark, source["root"], source["include"], source["exclude"], content)
        return rows.withColumn("source_id", F.lit(source["id"]))

    def _indexed(self, source_id: str) -> DataFrame:
        if self.store.exists("docs"):
            return self.store.read("docs").where(F.col("source_id") == source_id).select("doc_id", "source_id", "rel_path", "size", "mtime", "sha1")
        return self.spark.createDataFrame([], "doc_id long, source_id string, rel_path string, size long, mtime double, sha1 string")

    def pending(self, source: dict) -> DataFrame:
        """(source_id, rel_path, change) of one source."""
        return scan_changes(self._listing(source, False), self._indexed(source["id"]))

    def run(self, source: dict, full: bool = False, most: int | None = None) -> Run:
        """Bring one source up to date; ``most`` bounds the files read in this run, the rest is left to the next.

        Only files that are new or whose time or size changed are read; of these, files
        with the digest they had get the new stamp only. Removals come from the complete
        listing. What the documents stand on is stored first: chunks and full-text index,
        the log, then the documents with their new digest, and vectors last. A run that
        breaks off leaves documents with their old digest, so the next one makes them again.
        """
        out = Run(source["id"])
        if not self.settings["scan"]["auto_index"]:
            out.locked = True
            out.notes.append("indexing is switched off")
            return out
        before, limit = folder_version(source["root"]), self.settings["scan"]["max_file_bytes"]
        have = self._indexed(source["id"])
        changes = self.pending(source).cache()
        wanted = changes.where("change <> 'removed'").select("source_id", "rel_path")
        if most is not None:
            wanted = wanted.orderBy("source_id", "rel_path").limit(most)
        files = self._listing(source, True)
        files = files if full else files.join(wanted, ["source_id", "rel_path"], "left_semi")
        read = files.select("*", digest(F.col("content"), limit).alias("sha1"), decoded(F.col("content"), limit).alias("text")).drop("content")
        known = have.select("source_id", "rel_path", F.col("sha1").alias("had"))
        read = read.join(known, ["source_id", "rel_path"], "left").cache()
        touched = read.where(F.col("had") == F.col("sha1")) if not full else read.where("false")
        # written, as the documents they were found among are replaced before they are used
        touched = stage(touched.select("source_id", "rel_path", "size", "mtime"))
        fresh = read if full else read.where(~F.col("had").eqNullSafe(F.col("sha1")))
        docs = parse_documents(fresh.withColumn("doc_id", F.xxhash64("source_id", "rel_path")), source["clean"], self.settings["scan"]["min_body_chars"])
        chunk = self.settings["chunk"]
        docs = docs.cache()
        chunks = document_chunks(docs, chunk["size"], chunk["overlap"]).cache()
        counted = docs.join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_chunks")), "doc_id", "left")
        counted = counted.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).withColumn("indexed_at", F.lit(now()))
        removed = stage(changes.where("change = 'removed'").join(have, ["source_id", "rel_path"]).select("doc_id"))
        stale = stage(removed.union(docs.select("doc_id")).distinct())
        out.counts = {
            "removed": removed.count(), "touched": touched.count(), "new": changes.where("change = 'new'").count(), "processed": docs.count(),
            "dead": docs.where("state = 'dead'").count(), "empty": docs.where("state = 'empty'").count(), "chunks": chunks.count(),
        }
        log = counted.select(F.lit(now()).alias("ts"), "source_id", "rel_path", F.lit("index").alias("action"), F.lit("ok").alias("result"), F.coalesce("note", F.lit("")).alias("note"), F.lit(0).cast("long").alias("ms"))
        if not stale.isEmpty():
            self.store.delete_documents(stale, docs=None)
        if out.counts["chunks"]:
            self.store.append("postings", placed_postings(chunks))
            self.store.append("indexed", indexed_rows(chunks))
            self.store.append("chunks", chunks)
        if out.counts["processed"]:
            self.store.append("index_log", log)
            self.store.upsert("docs", counted.select(*DOC_COLUMNS), ["doc_id"])
        if out.counts["touched"]:
            self.store.update("docs", touched, ["source_id", "rel_path"])
        if out.counts["removed"]:
            self.store.delete("docs", removed)
        for df in (changes, read, docs, chunks):
            df.unpersist()
        if folder_version(source["root"]) != before:
            out.notes.append("the source folder changed during the run")
        out.counts["vectors"] = self.fill_vectors(out.notes)
        return out

    def text_index(self) -> TextIndex | None:
        """The stored full-text index."""
        return TextIndex.of(self.store.read("postings"), self.store.read("indexed")) if self.store.exists("postings") else None

    def search(self, query: str, **options: Any) -> Result:
        """Search the stored tables after a look for changes."""
        notes = [n for run in self.ensure_fresh() for n in run.notes]
        vectors = self.store.read("embeddings") if self.store.exists("embeddings") else None
        found = search(
            self.store.read("docs"), self.store.read("chunks"), query, vectors, self.embedder, index=self.text_index(),
            query_prefix=self.settings["embed"]["query_prefix"], **options,
        )
        found.notes[:0] = notes
        return found

    def health(self) -> DataFrame:
        """(name, bad): chunks without a row of the full-text index, rows without a chunk, rows of another text, postings without a row."""
        chunks, indexed = self.store.read("chunks"), self.store.read("indexed")
        return index_health(chunks, indexed, self.store.read("postings"))

    def fill_vectors(self, notes: list[str], docs_per_run: int = 400) -> int:
        """Make missing vectors; refused with a note while stored vectors are of another model."""
        if self.embedder is None or not self.embedder.available or not self.store.exists("chunks"):
            return 0
        if self.store.exists("embeddings"):
            have = self.store.read("embeddings")
            model = dominant_model(have).first()
            if model and model["model"] != self.embedder.model_id:
                notes.append(f"vectors are of {model['model']}; rebuild them before {self.embedder.model_id} is used")
                return 0
        else:
            have = self.spark.createDataFrame([], "chunk_id long, model string, dim int, vec array<float>")
        missing = backfill(self.store.read("chunks"), have, docs_per_run)
        fresh = embed(missing, self.embedder, self.settings["embed"]["doc_prefix"]).cache()
        n = fresh.count()
        if n:
            self.store.append("embeddings", fresh)
        fresh.unpersist()
        return n

    def ensure_fresh(self) -> list[Run]:
        """Index what changed, unless indexing is off, was checked a moment ago, or a job runs."""
        scan = self.settings["scan"]
        if not scan["auto_index"] or time.monotonic() - self._checked < scan["stale_check_seconds"] and self._checked or self.jobs.busy():
            return []
        self._checked = time.monotonic()
        return [self.run(s) for s in self.settings["sources"] if not self.pending(s).isEmpty()]

    def reindex(self, full: bool = False, source: str | None = None, seconds: float | None = None) -> list[Run]:
        """Index all sources or one as a job; an unknown source is an error, a second job is refused.

        After ``seconds`` no further source is begun; what is left is found by the next job.
        """
        sources = [s for s in self.settings["sources"] if source in (None, s["id"])]
        if source and not sources:
            raise ValueError(f"unknown source {source!r}")
        if self.jobs.busy():
            raise RuntimeError("another job runs")
        job, runs, began = self.jobs.start("full" if full else "incremental", len(sources)), [], time.monotonic()
        try:
            for s in sources:
                if seconds is not None and time.monotonic() - began > seconds:
                    runs[-1].notes.append("the time is up") if runs else None
                    break
                runs.append(self.run(s, full))
                self.jobs.update(job, done=len(runs))
        except Exception as e:
            self.jobs.finish(job, "done_with_errors", str(e)[:200])
            raise
        self.jobs.finish(job, "skipped_locked" if runs and all(r.locked for r in runs) else "done")
        return runs
