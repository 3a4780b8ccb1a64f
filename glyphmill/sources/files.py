"""Files as a table: listing with globs, reading, decoding, version of the source folder."""

from __future__ import annotations

import fnmatch
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a listing passes over.
SKIPPED = (".git", ".venv", "node_modules", "__pycache__", ".idea", ".vscode")
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def glob_match(rel: Column, name: Column, patterns: list[str]) -> Column:
    """Whether a path or a bare name matches one of the globs; '**/x' also means 'x', '*' crosses folders."""
    out = F.lit(False)
    for p in patterns:
        for form in {p, p[3:] if p.startswith("**/") else p}:
            rx = re.sub(r"\\([zZ])$", r"\\z", fnmatch.translate(form).replace("(?s:", "(?s:^"))
            out = out | rel.rlike(rx) | name.rlike(rx)
    return out


def list_files(spark: SparkSession, root: str, include: list[str], exclude: list[str], content: bool = False) -> DataFrame:
    """(rel_path, file_name, size, mtime[, content]) of the files under ``root``, without the skipped folders."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = Path(root).resolve().as_uri().rstrip("/") if "://" not in root else root.rstrip("/")
    bare = re.sub(r"^[a-z]+:/*", "/", base)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{re.escape(bare)}/", "")
    rows = rows.withColumn("rel_path", rel).withColumn("file_name", F.element_at(F.split("rel_path", "/"), -1))
    hidden = F.col("rel_path").rlike(r"(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/")
    kept = rows.where(~hidden & glob_match(F.col("rel_path"), F.col("file_name"), include) & ~glob_match(F.col("rel_path"), F.col("file_name"), exclude))
    columns = ["rel_path", "file_name", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("us")]
    out = kept.select(*columns, *(["content"] if content else []))
    return out.withColumn("mtime", F.col("us") / 1e6).drop("us")


def decoded(content: Column, max_bytes: int = 8_000_000) -> Column:
    """Text of the first ``max_bytes`` bytes as UTF-8, invalid bytes replaced."""
    return F.make_valid_utf8(F.substring(content, 1, max_bytes).cast("string"))


def digest(content: Column, max_bytes: int = 8_000_000) -> Column:
    """SHA-1 of the first ``max_bytes`` bytes."""
    return F.sha1(F.substring(content, 1, max_bytes))


def folder_version(root: str) -> str:
    """First 12 digits of the commit a checked-out folder stands at, else ''."""
    git = Path(root) / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref:"):
            return head[:12]
        ref = head[4:].strip()
        if (git / ref).exists():
            return (git / ref).read_text().strip()[:12]
        packed = (git / "packed-refs").read_text().splitlines()
        return next((line.split()[0][:12] for line in packed if line.endswith(f" {ref}")), "")
    except OSError:
        return ""
